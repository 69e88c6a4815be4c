"""Small helpers on tables: reading, ids, intermediate results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.tables import settle, shared_folder  # noqa: F401  (used from here)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def carried(column: str) -> Column:
    """An id as text, for the way through Python tasks: pandas turns whole numbers beside a null into
    floats, which lose digits."""
    return F.col(column).cast("string")


def discard(*frames: DataFrame) -> None:
    """Delete tables made by settle() that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
            if "/part-" in file:
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
