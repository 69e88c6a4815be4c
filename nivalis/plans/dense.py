"""Dense prediction of many regions and months in one plan, and tables clustered by place.

All wanted (region, month) pairs go through one plan: cells are clipped and thinned by region, meet the
hours of their region's months, and take the lagged coarse fields of each hour.  The result is written
by region, year and month with cells in the order of their interleaved row and column numbers, so that
a file holds cells of one neighbourhood and its statistics let a reader of a box leave the others out.
Many small regions share the folder of their month and lie in it one after the other, so that files do
not number regions times months."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivalis.plans.folds import predict_with
from nivalis.plans.modelling import predict_sites
from nivalis.tables import exists


def thin_by_region(df: DataFrame, max_points: int = 130_000) -> DataFrame:
    """Every k-th row and column of each region, k the smallest stride that leaves at most max_points
    cells of the region's full rectangle."""
    span = df.groupBy("region").agg(F.min("iy").alias("_y0"), F.max("iy").alias("_y1"), F.min("ix").alias("_x0"), F.max("ix").alias("_x1"))
    rows, cols = F.col("_y1") - F.col("_y0") + 1, F.col("_x1") - F.col("_x0") + 1
    few = F.filter(F.sequence(F.lit(1), F.greatest(rows, cols)), lambda k: F.ceil(rows / k) * F.ceil(cols / k) <= max_points)
    strides = span.select("region", "_y0", "_x0", F.coalesce(F.get(few, F.lit(0)), F.greatest(rows, cols)).alias("_stride"))
    kept = df.join(strides, "region").filter(((F.col("iy") - F.col("_y0")) % F.col("_stride") == 0) & ((F.col("ix") - F.col("_x0")) % F.col("_stride") == 0))
    return kept.drop("_y0", "_x0", "_stride")


def predict_months(
    model, grid: DataFrame, cube: DataFrame, points: DataFrame, months: DataFrame, statics: Sequence[str], dynamics: Sequence[str],
    max_points: int = 130_000, margin: float = 500.0, base: str = "skt",
) -> DataFrame:
    """predict_grid for every (region, year, month) of `months` at once: (region, iy, ix, time,
    predictions). `model` is one model, or one for each (region, year)."""
    from nivalis.functions.timecols import cyclical_features
    from nivalis.operators.interpolate import interp_linear
    from nivalis.operators.select import bbox, clip_to_box, complete_cells
    from nivalis.operators.series import lag_features

    cells = thin_by_region(complete_cells(clip_to_box(grid, bbox(points, margin)), list(statics)), max_points)
    lagged = lag_features(cube, list(dynamics), ["lat", "lon"])
    values = [c for c in lagged.columns if c not in ("time", "lat", "lon")]
    asked = months.select("region", F.col("year").cast("int"), F.col("month").cast("int")).distinct()
    hours = lagged.select("time").distinct().withColumns({"year": F.year("time"), "month": F.month("time")})
    hours = hours.join(asked, ["year", "month"]).select("region", "time")
    wanted = lagged.join(hours.select("time").distinct(), "time", "left_semi")
    places = cells.select("region", "iy", "ix", "lat", "lon").join(hours, "region")
    keys = ["region", "iy", "ix", "time"]
    fields = interp_linear(places, wanted, values, ["lat", "lon"], ["time"], keys)
    rows = cyclical_features(fields.join(cells, keys[:3]))
    return predict_with(model, rows, base, keys) if isinstance(model, Mapping) else predict_sites(model, rows, base, keys)


def interleaved(y: str, x: str, bits: int = 20) -> Column:
    """One number from the bits of two, taken in turn: near numbers are near places."""
    spread = lambda c, by: [F.shiftleft(F.shiftright(F.col(c).cast("long"), b).bitwiseAND(F.lit(1)), 2 * b + by) for b in range(bits)]
    parts = [*spread(x, 0), *spread(y, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def write_tiles(df: DataFrame, path: str, partition_by: Sequence[str] = ("region", "year", "month"), cells_per_file: int = 1_000_000, y: str = "iy", x: str = "ix", within: Sequence[str] = ()) -> None:
    """Write a table of cells, clustered by place within each partition. Ranges of the interleaved place
    are cut by partition and place, so a large partition is dealt over tasks and none mixes
    neighbourhoods; partitions that are not in `df` stay. Columns `within` come before the place in the
    order of a partition's rows: groups too small for a folder each."""
    placed, order = df.withColumn("_place", interleaved(y, x)), [*partition_by, *within, "_place"]
    cut = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = cut.drop("_place").write.mode("overwrite").option("maxRecordsPerFile", cells_per_file)
    if exists(df.sparkSession, path):
        writer = writer.option("partitionOverwriteMode", "dynamic")  # folders are moved one by one by the driver
    else:  # nothing to keep: tasks move their own files
        writer = writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy(*partition_by).parquet(path)
