"""Reading and writing domain tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READINGS = (
    "region string, site string, tomst_id long, time timestamp, T1 double, T2 double, T3 double, "
    "lon double, lat double, x double, y double"
)


def standard_readings(df: DataFrame) -> DataFrame:
    """Name the time column `time` and make it a timestamp."""
    if "datetime" in df.columns:
        df = df.withColumnRenamed("datetime", "time")
    return df.withColumn("time", F.to_timestamp("time"))


def read_readings(spark: SparkSession, path: str, schema: str = READINGS, fmt: str = "csv") -> DataFrame:
    """Logger readings under a fixed schema."""
    reader = spark.read.schema(schema.replace(" time timestamp", " datetime string") if fmt == "csv" else schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return standard_readings(df)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop))


def read_many(spark: SparkSession, paths: Sequence[str], on_missing: str = "skip", fmt: str = "parquet") -> DataFrame:
    """One table from many files; absent ones are skipped or, with on_missing="fail", an error.
    Columns that a file lacks are null."""
    there = [p for p in paths if _exists(spark, p)]
    if len(there) < len(paths) and on_missing != "skip" or not there:
        raise FileNotFoundError(f"missing: {sorted(set(paths) - set(there))}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.format(fmt).load(p) for p in there))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table, its rows gathered by partition so that each has few files; a large partition is
    dealt over several tasks. Overwriting by partition leaves the other partitions alone."""
    out = df.hint("rebalance", *(F.col(c) for c in partition_by)) if partition_by else df
    writer = out.write.mode(mode).format(fmt).option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def nan_to_null(df: DataFrame, cols: Sequence[str], inf: bool = True) -> DataFrame:
    """NaN, and with `inf` infinities, become null."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf") if inf else F.lit(False))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c in cols})


def scale_packed(df: DataFrame, cols: Sequence[str], factor: float = 100.0) -> DataFrame:
    """Unpack integer-coded values."""
    return df.withColumns({c: F.col(c) / F.lit(factor) for c in cols})


def merge_variables(frames: Sequence[DataFrame], keys: Sequence[str] = ("time", "lat", "lon")) -> DataFrame:
    """Per-variable tables on one key, keeping every key."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), frames)


def grid_to_long(df: DataFrame, keys: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """One row per key and variable; keys without a value are left out."""
    cols = [c for c in df.columns if c not in keys]
    return df.unpivot(list(keys), cols, name, value).dropna(subset=[value])


def normalise_coords(df: DataFrame) -> DataFrame:
    """Coordinates named lon and lat, longitudes in [-180, 180)."""
    names = {"longitude": "lon", "latitude": "lat", "X": "lon", "Y": "lat"}
    out = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    wide = out.select(F.max("lon").alias("far"))
    turned = F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0
    return out.crossJoin(F.broadcast(wide)).withColumn("lon", F.when(F.col("far") > 180, turned).otherwise(F.col("lon"))).drop("far")


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def select_prefix(df: DataFrame, prefixes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *(c for c in df.columns if c.startswith(tuple(prefixes)) and c not in keep))


def assemble_predictors(readings: DataFrame, gridded: DataFrame, static: DataFrame) -> DataFrame:
    """Gridded and static predictors joined to readings by key (not by row position); a column that
    an earlier table has is not repeated."""
    keys = ["region", "site", "time"]
    new = [c for c in gridded.columns if c not in readings.columns or c in keys]
    out = readings.join(gridded.select(new), keys, "left")
    fresh = [c for c in static.columns if c not in out.columns or c in keys[:2]]
    return out.join(static.select(fresh), keys[:2], "left")


def cube_from_points(df: DataFrame, month: int, pivot: bool = False) -> DataFrame:
    """Rows of the wanted month on (time, y, x); with `pivot`, a column for every x."""
    out = df.filter(F.month("time") == month)
    return out.groupBy("time", "y").pivot("x").agg(F.first("value")) if pivot else out


def read_model_output_at_sites(cube: DataFrame, sites: DataFrame, evaluation: DataFrame, value: str, name: str) -> DataFrame:
    """A model cube (time, y, x, value) interpolated to sites, at the sites and hours that the evaluation
    table has, and left-joined to it."""
    from nivalis.operators.interpolate import interp_bilinear

    wanted = evaluation.select("site", "time").distinct().join(cube.select("time").distinct(), "time", "left_semi")
    points = wanted.join(sites.select("site", "x", "y"), "site")
    at = interp_bilinear(points, cube, value, keys=["time"], point_id=["site", "time"])
    return evaluation.join(at.select("site", "time", F.col(value).alias(name)), ["site", "time"], "left")
