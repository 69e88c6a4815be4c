"""Joins of points with grids. A place on a regular axis comes by arithmetic, on an irregular one by
binary search in its sorted coordinates, so every join is an equi join. Axes of space are held in a row
(a number a grid line); the times of points are bracketed range by range, however many there are."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from operator import add, mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nivalis.operators.ranges import PIECES, with_piece
from nivalis.tables import settle


def axis(grid: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Origin, step and size of each axis per key, and its sorted coordinates where their steps differ:
    one small row each. Each axis is read off its distinct coordinates."""
    out = None
    for c in cols:
        ordered = Window.partitionBy(*keys).orderBy(c)  # the coordinates of one axis
        steps = grid.select(*keys, c).distinct().withColumn("_gap", F.col(c) - F.lag(c).over(ordered))
        n, step = F.count(c), F.try_divide(F.max(c) - F.min(c), F.count(c) - 1)
        uneven = F.max("_gap") - F.min("_gap") > 1e-6 * step
        made = steps.groupBy(*keys).agg(
            F.min(c).alias(f"_o_{c}"), step.alias(f"_s_{c}"), n.alias(f"_n_{c}"), F.when(uneven, F.sort_array(F.collect_list(c))).alias(f"_a_{c}")
        )
        out = made if out is None else out.join(made, list(keys)) if keys else out.crossJoin(made)  # one row without keys
    return out


def _with_axis(df: DataFrame, axes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(axes, list(keys)) if keys else df.crossJoin(F.broadcast(axes))  # one row without keys


def _searched(axis: Column, v: Column) -> Column:
    """Position of a value between the coordinates of an axis, beyond its ends by the outer steps."""
    last = F.size(axis) - 1
    start = F.struct(F.lit(0).alias("lo"), (last - 1).alias("hi"))

    def halve(s: Column, _) -> Column:
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        up = F.get(axis, middle) <= v
        return F.struct(F.when(up, middle).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(F.greatest(middle - 1, s["lo"])).alias("hi"))

    k = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(axis) + 1.0)).cast("int")), start, halve)["lo"]
    return k + (v - F.get(axis, k)) / (F.get(axis, k + 1) - F.get(axis, k))


def _place(c: str) -> Column:
    """Position along an axis in steps, free of rounding noise at grid lines."""
    exact = (F.col(c) - F.col(f"_o_{c}")) / F.col(f"_s_{c}")
    even = F.when(F.abs(exact - F.round(exact)) < 1e-9, F.round(exact)).otherwise(exact)
    return F.when(F.col(f"_a_{c}").isNull(), even).otherwise(_searched(F.col(f"_a_{c}"), F.col(c).cast("double")))


def _cells(grid: DataFrame, axes: DataFrame, cols: Sequence[str], values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    named = {f"_i_{c}": F.round(_place(c)).cast("int") for c in cols}
    return _with_axis(grid.select(*keys, *cols, *values), axes, keys).select(*keys, *(v.alias(k) for k, v in named.items()), *values)


def nearest_cell(points: DataFrame, grid: DataFrame, cols: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Nearest coordinate of a grid, each axis by itself (halves go down, ends hold)."""
    axes = axis(grid, cols)
    out = _with_axis(points, axes, ())
    for c in cols:
        i = F.least(F.greatest(F.ceil(_place(c) - 0.5), F.lit(0)), F.col(f"_n_{c}") - 1)
        even = F.col(f"_o_{c}") + i * F.col(f"_s_{c}")
        out = out.withColumn(f"cell_{c}", F.when(F.col(f"_a_{c}").isNull(), even).otherwise(F.get(f"_a_{c}", i.cast("int"))))
    return out.drop(*axes.columns)


def _packed(cells: DataFrame, cols: Sequence[str], values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """For each place a row with the values of its 2^d corners, as <value>_<corner>, corners in the order
    of their steps; so a point needs one join and no regrouping. Places that lack all are absent."""
    index = [f"_i_{c}" for c in cols]
    corners = F.array(*(
        F.struct(*((F.col(i) - e).cast("int").alias(i) for i, e in zip(index, steps, strict=True)), F.lit(k).alias("_k"))
        for k, steps in enumerate(product((0, 1), repeat=len(cols)))
    ))
    dealt = cells.select(*keys, *values, F.explode(corners).alias("_c")).select(*keys, *values, "_c.*")
    return dealt.groupBy(*keys, *index).agg(*(F.max(F.when(F.col("_k") == k, F.col(v))).alias(f"_{k}_{v}") for v in values for k in range(2 ** len(cols))))


def _placed(at: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Points with axes get _i_<col>, the grid line before them, _w_<col>, the share of the next one,
    _b_<k>, the weight of corner k, and _inside. The last grid line belongs to the cell before it."""
    inside = F.lit(True)
    for c in cols:
        inside = inside & _place(c).between(0, F.col(f"_n_{c}") - 1)
    at = at.withColumns({"_inside": F.coalesce(inside, F.lit(False))} | {f"_p_{c}": _place(c) for c in cols})
    at = at.withColumns({f"_i_{c}": F.least(F.floor(f"_p_{c}"), F.greatest(F.col(f"_n_{c}") - 2, F.lit(0))).cast("int") for c in cols})
    at = at.withColumns({f"_w_{c}": F.col(f"_p_{c}") - F.col(f"_i_{c}") for c in cols})
    weights = {}
    for k, steps in enumerate(product((0, 1), repeat=len(cols))):
        weights[f"_b_{k}"] = reduce(mul, (F.col(f"_w_{c}") if e else 1 - F.col(f"_w_{c}") for c, e in zip(cols, steps, strict=True)), F.lit(1.0))
    return at.withColumns(weights)


def _weights(cols: Sequence[str]) -> list[str]:
    return [f"_b_{k}" for k in range(2 ** len(cols))]


def _blended(value: str, cols: Sequence[str]) -> Column:
    """Sum of the corners by weight; null where a corner with weight is missing."""
    return reduce(add, (F.when(F.col(w) > 0, F.col(w) * F.col(f"_{k}_{value}")).otherwise(0.0) for k, w in enumerate(_weights(cols))), F.lit(0.0))


def interp_linear(points: DataFrame, grid: DataFrame, values: Sequence[str], cols: Sequence[str], keys: Sequence[str] = (), point_id: Sequence[str] = ("site",)) -> DataFrame:
    """Linear in every axis from the 2^d corners; null outside the grid or where a corner with weight
    is missing. Points keep the columns keys and point_id."""
    own = [*dict.fromkeys([*keys, *point_id])]
    axes = settle(axis(grid, cols, keys), "axes")  # used for the points and for the cells
    at = points.select(*dict.fromkeys([*own, *cols]))
    at = _placed(at.join(axes, list(keys), "left") if keys else at.crossJoin(F.broadcast(axes)), cols)  # one row without keys
    near = _packed(_cells(grid, axes, cols, values, keys), cols, values, keys)
    met = at.select(*dict.fromkeys([*own, *cols]), "_inside", *(f"_i_{c}" for c in cols), *_weights(cols)).join(near, [*keys, *(f"_i_{c}" for c in cols)], "left")
    return met.select(*own, *(F.when(F.col("_inside"), _blended(v, cols)).alias(v) for v in values))


def interp_bilinear(points: DataFrame, grid: DataFrame, value: str | Sequence[str], keys: Sequence[str] = (), point_id: Sequence[str] = ("site",), cols: Sequence[str] = ("x", "y")) -> DataFrame:
    return interp_linear(points, grid, [value] if isinstance(value, str) else value, list(cols), keys, point_id)


def bracket_times(points: DataFrame, cube: DataFrame, time_col: str = "time", pieces: int = PIECES) -> DataFrame:
    """For each distinct point time the cube times before and after it and the weight of the later:
    (time, t0, t1, wt). Time axes may be irregular. Times are cut into ranges; within one they are
    sorted, and the last known time before it and the first behind it come from a row of all ranges."""
    known = cube.select(time_col).distinct().withColumn("_known", F.col(time_col))
    wanted = points.select(time_col).distinct().withColumn("_known", F.lit(None).cast("timestamp"))
    both = known.unionByName(wanted).groupBy(time_col).agg(F.max("_known").alias("_known"))
    placed = settle(with_piece(settle(both, "times"), time_col, pieces=pieces), "pieces")
    ends = placed.groupBy("_piece").agg(F.min("_known").alias("lo"), F.max("_known").alias("hi"))
    row = ends.agg(F.collect_list(F.struct("_piece", "lo", "hi")).alias("_ends"))  # `pieces` entries at most
    order = Window.partitionBy("_piece").orderBy(time_col)
    before = F.array_max(F.transform(F.filter("_ends", lambda e: e["_piece"] < F.col("_piece")), lambda e: e["hi"]))
    after = F.array_min(F.transform(F.filter("_ends", lambda e: e["_piece"] > F.col("_piece")), lambda e: e["lo"]))
    out = placed.withColumns({
        "_t0": F.last("_known", True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_t1": F.first("_known", True).over(order.rowsBetween(0, Window.unboundedFollowing)),
    }).crossJoin(F.broadcast(row)).select(time_col, F.coalesce("_t0", before).alias("t0"), F.coalesce("_t1", after).alias("t1"))
    seconds = lambda c: F.unix_timestamp(c)
    part = F.try_divide(seconds(time_col) - seconds("t0"), seconds("t1") - seconds("t0"))
    return out.withColumn("wt", F.coalesce(part, F.when(F.col("t0") == F.col("t1"), 0.0)))


def interp_trilinear(points: DataFrame, cube: DataFrame, values: Sequence[str], point_id: Sequence[str] = ("site", "time"), cols: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Bilinear in space at the two bracketing times, linear between them. The corners of a place are mixed
    in time once for all points that it has at a time, however many they are."""
    axes = settle(axis(cube, cols), "axes")  # one row, used twice
    cells = _cells(cube.withColumnRenamed("time", "_at"), axes, cols, ["_at", *values], ())
    near = settle(_packed(cells, cols, values, ["_at"]), "corners")  # joined at either time
    own, index = [*dict.fromkeys([*point_id, *cols])], [f"_i_{c}" for c in cols]
    at = _placed(points.select(*dict.fromkeys(["time", *own])).crossJoin(F.broadcast(axes)), cols).select("time", *own, "_inside", *index, *_weights(cols))
    met = at.filter("_inside").select("time", *index).distinct().join(bracket_times(points, cube), "time").filter("wt is not null")
    packed = [f"_{k}_{v}" for v in values for k in range(2 ** len(cols))]
    for side, t in (("a", "t0"), ("b", "t1")):
        met = met.join(near.select(F.col("_at").alias(t), *index, *(F.col(c).alias(f"{side}{c}") for c in packed)), [t, *index], "left")
    between = lambda c: F.when(F.col("wt") < 1, (1 - F.col("wt")) * F.col(f"a{c}")).otherwise(0.0) + F.when(F.col("wt") > 0, F.col("wt") * F.col(f"b{c}")).otherwise(0.0)
    mixed = settle(met.select("time", *index, F.lit(True).alias("_met"), *(between(c).alias(c) for c in packed)), "mixed")
    both = at.join(mixed, ["time", *index], "left")
    return both.select(*point_id, *(F.when(F.col("_inside") & F.col("_met"), _blended(v, cols)).alias(v) for v in values))


def regrid(grid: DataFrame, lats: Sequence[float], lons: Sequence[float], values: Sequence[str], method: str = "nearest") -> DataFrame:
    """Every variable on new axes (the arrays of the new axes make the target cells)."""
    spark = grid.sparkSession
    cells = spark.createDataFrame([(float(a),) for a in lats], "lat double").crossJoin(spark.createDataFrame([(float(b),) for b in lons], "lon double"))
    if method == "linear":
        return interp_linear(cells, grid, values, ["lat", "lon"], (), ("lat", "lon"))
    near = nearest_cell(cells, grid)
    index = lambda c: F.round(F.col(c), 9)
    source = grid.select(index("lat").alias("_a"), index("lon").alias("_b"), *values)
    return near.withColumns({"_a": index("cell_lat"), "_b": index("cell_lon")}).join(source, ["_a", "_b"], "left").select("lat", "lon", *values)


def align_to_template(layer: DataFrame, template: DataFrame, values: Sequence[str], keys: Sequence[str] = ("region",)) -> DataFrame:
    """A layer of other resolution on the template's cells (nearest). Equal axes need no work."""
    cols = ["x", "y"]
    own, wanted = settle(axis(layer, cols, keys), "axes"), axis(template, cols, keys)
    if own.exceptAll(wanted).isEmpty() and wanted.exceptAll(own).isEmpty():
        return layer.select(*keys, *cols, *values)
    cells = _cells(layer, own, cols, values, keys)
    at = _with_axis(template.select(*keys, *cols).distinct(), own, keys)
    for c in cols:
        at = at.withColumn(f"_i_{c}", F.least(F.greatest(F.ceil(_place(c) - 0.5), F.lit(0)), F.col(f"_n_{c}") - 1).cast("int"))
    return at.join(cells, [*keys, "_i_x", "_i_y"], "left").select(*keys, *cols, *values)


def stack_layers(layers: Sequence[DataFrame], keys: Sequence[str] = ("region", "iy", "ix")) -> DataFrame:
    out = layers[0]
    for more in layers[1:]:
        out = out.join(more, list(keys), "full")
    return out


def interp_like(mask: DataFrame, cells: DataFrame, value: str, keys: Sequence[str] = ("region",)) -> DataFrame:
    """A mask resampled to the cells (keys, x, y) of another grid."""
    return interp_bilinear(cells, mask, value, keys=keys, point_id=[*keys, "x", "y"])


def expand_static(static: DataFrame, dynamic: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Static fields at every time that the dynamic fields have for the cell."""
    return dynamic.join(static, list(cell))


def attach_site_coords(readings: DataFrame, sites: DataFrame) -> DataFrame:
    return readings.join(sites.select("site", "x", "y", "lat", "lon"), "site", "left")


def attach_model(evaluation: DataFrame, sim: DataFrame, keys: Sequence[str] = ("site", "time")) -> DataFrame:
    return evaluation.join(sim, list(keys), "left")


def broadcast_group_stat(df: DataFrame, keys: Sequence[str], value: str, stat, name: str) -> DataFrame:
    """Value less a statistic of its group."""
    return df.join(df.groupBy(*keys).agg(stat(value).alias("_stat")), list(keys)).withColumn(name, F.col(value) - F.col("_stat")).drop("_stat")
