"""k-means of many groups at once.

Every step is one aggregate over all groups: a group's seeds are drawn one after another by hash, each
with a chance that grows with the squared distance to those drawn before, and in each round all rows
meet their group's centres and give the next ones.  A group whose centres stand still leaves the rounds.
So the number of jobs follows the number of seeds and rounds, not that of groups.

Rows and centres are plain columns, _z0, _z1, ... and _c0_0, _c0_1, ..., so that distances are compiled
arithmetic; a group with fewer centres has nulls in the last ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivalis.operators.ranges import join_groups
from nivalis.tables import settle


def _names(k: int, width: int) -> list[list[str]]:
    return [[f"_c{i}_{j}" for j in range(width)] for i in range(k)]


def _apart(centre: Sequence[str], width: int) -> Column:
    """Squared distance of a row to a centre; null without one."""
    return sum((F.pow(F.col(f"_z{j}") - F.col(c), F.lit(2.0)) for j, c in enumerate(centre)), F.lit(0.0))


def _with_nearest(met: DataFrame, k: int, width: int) -> DataFrame:
    """Adds _d, the squared distance to the nearest centre, and _k, its place; the first of equals."""
    far = met.withColumns({f"_d{i}": _apart(c, width) for i, c in enumerate(_names(k, width))})
    least = F.least(*(F.col(f"_d{i}") for i in range(k))) if k > 1 else F.col("_d0")
    place = F.coalesce(*(F.when(F.col(f"_d{i}") == F.col("_d"), F.lit(i)) for i in range(k)))
    return far.withColumn("_d", least).withColumn("_k", place).drop(*(f"_d{i}" for i in range(k)))


def _chance(seed: int, draw: int) -> Column:
    """A number in (0, 1) for each row and draw."""
    return (F.shiftrightunsigned(F.xxhash64("_row", F.lit(seed), F.lit(draw)), 11) + 0.5) / float(1 << 53)


def _seeds(rows: DataFrame, by: str, k: int, seed: int, width: int) -> DataFrame:
    """(group, centres): of a race of exponentials with the squared distances as rates, the first wins.
    Rows that lie on a centre stay out; a group may so get fewer centres."""
    centres, names = None, _names(k, width)
    place = F.struct(*(f"_z{j}" for j in range(width)))
    for draw in range(k):
        late = -F.log(_chance(seed, draw))
        if centres is None:
            race = rows.withColumn("_late", late)
        else:
            met = _with_nearest(join_groups(rows, centres, [by]), draw, width)
            race = met.filter("_d > 0").withColumn("_late", late / F.col("_d"))
        won = race.groupBy(by).agg(F.min(F.struct(F.col("_late"), place.alias("_z"))).alias("_won"))
        won = won.select(by, *(F.col(f"_won._z._z{j}").alias(names[draw][j]) for j in range(width)))
        centres = settle(won if centres is None else join_groups(centres, won, [by]), "centres")
    return centres


def grouped_k_means(rows: DataFrame, by: str, k: int, seed: int, width: int, rounds: int | None = 20, tolerance: float = 1e-4) -> DataFrame:
    """(group, _c0_0, ...) of rows (group, _z0, ..., _row). Without `rounds` a group goes on until its
    centres stand still, which every group does, since its rows come nearer to their centres each round."""
    names, done = _names(k, width), None
    flat = [c for centre in names for c in centre]
    centres = _seeds(rows, by, k, seed, width).withColumn("_still", F.lit(False))
    while rounds is None or rounds > 0:
        live = centres.filter("not _still").select(by, *flat)
        placed = rows.join(live.withColumnRenamed(by, "_g"), F.col(by).eqNullSafe(F.col("_g"))).drop("_g")
        placed = _with_nearest(placed, k, width)
        fresh = placed.groupBy(by).agg(*(F.avg(F.when(F.col("_k") == i, F.col(f"_z{j}"))).alias(f"_m{i}_{j}") for i in range(k) for j in range(width)))
        after = join_groups(live, fresh, [by])
        moved = {c: F.coalesce(f"_m{i}_{j}", c) for i in range(k) for j, c in enumerate(names[i])}  # an empty cluster stays where it was
        steps = [sum((F.pow(moved[c] - F.col(c), F.lit(2.0)) for c in centre), F.lit(0.0)) for centre in names]
        still = F.coalesce(F.greatest(*steps) if k > 1 else steps[0], F.lit(0.0)) <= tolerance * tolerance
        centres = settle(after.select(by, *(m.alias(c) for c, m in moved.items()), still.alias("_still")), "centres")
        ended = centres.filter("_still").select(by, *flat)
        done = ended if done is None else done.unionByName(ended)
        rounds = rounds if rounds is None else rounds - 1
        if centres.filter("not _still").isEmpty():
            break
    rest = centres.filter("not _still").select(by, *flat)
    return done.unionByName(rest) if done is not None else rest


def cluster_regimes(df: DataFrame, cols: Sequence[str], k: int = 3, least: int = 100, seed: int = 0, by: str = "region", rounds: int | None = 20, tolerance: float = 1e-4) -> DataFrame:
    """k-means of columns standardised by group, group by group; groups with few complete rows are left
    out. Adds cluster, the place of the nearest centre. Without `rounds` every group goes on until no
    centre moves by more than the tolerance."""
    whole = settle(df.dropna(subset=list(cols)), "whole")
    sizes = whole.groupBy(by).agg(F.count("*").alias("_n"), *(f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    sizes = settle(sizes.filter(F.col("_n") >= least), "sizes")
    scaled = {f"_z{j}": F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), f"_s_{c}"), F.lit(0.0)) for j, c in enumerate(cols)}
    met = join_groups(whole, sizes, [by]).filter("_n is not null").withColumns(scaled)
    rows = settle(met.select(*df.columns, *scaled, F.xxhash64(*df.columns).alias("_row")), "scaled")
    centres = grouped_k_means(rows.select(by, *scaled, "_row"), by, k, seed, len(cols), rounds, tolerance)
    out = _with_nearest(join_groups(rows, centres, [by]), k, len(cols))
    return out.select(*df.columns, F.col("_k").alias("cluster"))
