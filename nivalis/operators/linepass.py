"""Sums along lines of a grid, without a pair join.

Along a line every position is present (its value may be null).  Lines are cut into tiles, each with
as many neighbouring cells on either side as a sum reaches, so neither a task nor an array holds a
line, however long.  Two passes, one per axis, make a separable two-dimensional filter.

A weighted pass gathers a tile as an array in order of position and forms each sum by a higher-order
aggregate.  A box pass takes running sums of a tile and reads two of them per cell, whatever the
window; what reaches beyond an end of the line is the end's value, as often as it is reached."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a tile at least; a tile is no shorter than four times its reach.
TILE = 4096


def gaussian_weights(sigma: float, truncate: float = 4.0) -> tuple[int, list[float]]:
    """First offset and weights, to int(truncate * sigma + 0.5) places on either side."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return -radius, [w / sum(raw) for w in raw]


def blackman_weights(n: int) -> tuple[int, list[float]]:
    """Normalised Blackman window, centred as in a convolution of equal length."""
    raw = [0.42 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) + 0.08 * math.cos(4 * math.pi * k / (n - 1)) for k in range(n)] if n > 1 else [1.0]
    return -((n - 1) - (n - 1) // 2), [w / sum(raw) for w in raw]


def _tiled(df: DataFrame, line: Sequence[str], pos: str, values: Sequence[str], before: int, after: int, tile: int) -> DataFrame:
    """(line, _tile, pos, values, _own): each cell once in its own tile and once in every other that
    reaches it, from `before` cells ahead of a tile to `after` behind it."""
    own = F.floor(F.col(pos) / tile)
    tiles = F.sequence(F.floor((F.col(pos) - after) / tile), F.floor((F.col(pos) + before) / tile))
    return df.select(*line, pos, *values, F.explode(tiles).alias("_tile")).withColumn("_own", F.col("_tile") == own)


def box_pass(df: DataFrame, line: Sequence[str], pos: str, values: Sequence[str], win: int, tile: int | None = None) -> DataFrame:
    """The sum over `win` cells around each for each value column, ends repeated; even windows reach one
    further back. Nulls count as 0."""
    lo, hi = -(win // 2), win - 1 - win // 2
    cells = _tiled(df, line, pos, values, -lo, hi, tile or max(TILE, 4 * win))
    order = Window.partitionBy(*line, "_tile").orderBy(pos)
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = {v: F.coalesce(F.col(v), F.lit(0.0)) for v in values}
    sums = cells.withColumns(named).withColumns({f"_sum_{v}": F.sum(v).over(so_far) for v in values})
    # where a tile does not begin or end with its line, its first and last cells are out of reach of its own ones
    edges = {"_begin": F.first(pos).over(whole), "_end": F.last(pos).over(whole)}
    for v in values:
        edges |= {f"_first_{v}": F.first(v).over(whole), f"_last_{v}": F.last(v).over(whole), f"_all_{v}": F.last(f"_sum_{v}").over(whole)}
        edges |= {f"_to_{v}": F.lead(f"_sum_{v}", hi).over(order), f"_from_{v}": F.lag(f"_sum_{v}", 1 - lo).over(order)}
    read = sums.withColumns(edges).filter("_own")
    zero = F.lit(0)
    early = F.greatest(zero, F.col("_begin") - (F.col(pos) + lo))
    late = F.greatest(zero, F.col(pos) + hi - F.col("_end"))
    total = lambda v: F.coalesce(f"_to_{v}", f"_all_{v}") - F.coalesce(f"_from_{v}", F.lit(0.0)) + early * F.col(f"_first_{v}") + late * F.col(f"_last_{v}")
    return read.select(*line, pos, *(total(v).alias(v) for v in values))


def line_pass(df: DataFrame, line: Sequence[str], pos: str, values: Sequence[str], lo: int, weights: Sequence[float], mode: str, tile: int | None = None) -> DataFrame:
    """sum_k weights[k] * value[pos + lo + k] for each value column; a null in reach makes the sum
    null. Ends: `wrap`, `nearest` (edge repeated) or `zero`."""
    hi = lo + len(weights) - 1
    before, after = max(0, -lo), max(0, hi)
    cells = df.select(*line, pos, *values)
    if mode == "wrap":  # the ends of a line come again beyond each other
        span = cells.groupBy(*line).agg(F.min(pos).alias("_begin"), F.count("*").alias("_n"))
        turns = F.sequence(F.floor((F.col("_begin") - before - F.col(pos)) / F.col("_n")), F.ceil((F.col("_begin") + F.col("_n") - 1 + after - F.col(pos)) / F.col("_n")))
        cells = cells.join(span, list(line)).withColumn("_turn", F.explode(turns))
        cells = cells.select(*line, (F.col(pos) + F.col("_turn") * F.col("_n")).cast("int").alias(pos), *values, (F.col("_turn") == 0).alias("_real"))
    else:
        cells = cells.withColumn("_real", F.lit(True))
    dealt = _tiled(cells, line, pos, [*values, "_real"], before, after, tile or max(TILE, 4 * len(weights)))
    cell = F.struct(F.col(pos).alias("pos"), (F.col("_own") & F.col("_real")).alias("own"), *values)
    lines = dealt.select(*line, "_tile", cell.alias("_cell")).groupBy(*line, "_tile").agg(F.sort_array(F.collect_list("_cell")).alias("_a"))
    size = F.size("_a")
    weight = F.array(*(F.lit(float(w)) for w in weights))

    def at(name: str, i):
        if mode == "nearest":
            return F.get("_a", F.least(F.greatest(i, F.lit(0)), size - 1))[name]
        return F.when((i < 0) | (i >= size), F.lit(0.0)).otherwise(F.get("_a", i)[name])

    def total(name: str, i):
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(len(weights) - 1)), F.lit(0.0), lambda acc, k: acc + F.get(weight, k) * at(name, i + lo + k)
        )

    mine = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.get("_a", i)["own"])
    made = F.transform(mine, lambda i: F.struct(F.get("_a", i)["pos"].alias("pos"), *(total(v, i).alias(v) for v in values)))
    return lines.select(*line, F.explode(made).alias("_m")).select(*line, F.col("_m.pos").alias(pos), *(F.col(f"_m.{v}").alias(v) for v in values))
