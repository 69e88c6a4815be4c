"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_recorded: ContextVar[list[str] | None] = ContextVar("recorded", default=None)


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def size_of(spark: SparkSession, folder: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    path, files = _files(spark, folder)
    return int(files.getContentSummary(path).getLength())


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = _files(spark, folder)
    return files.exists(path)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that spark.checkpoint.dir names; it is deleted when the
    application ends. Only a local session may go without the setting; its tables lie under the
    warehouse."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = f"{given or spark.conf.get('spark.sql.warehouse.dir')}/nivalis-{spark.sparkContext.applicationId}"
    path, files = _files(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def settle(df: DataFrame, what: str, tidy: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Write and read again: cuts lineage, so that iterations stay cheap and lost executors do no harm.
    Rows lie in a folder for each value of the columns `by`, which are read last. With `tidy`, Spark is made to drop the shuffle files that led to the table, which otherwise wait
    for the driver's next garbage collection."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    if (paths := _recorded.get()) is not None:
        paths.append(path)
    if tidy:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recording(paths: list[str]) -> Iterator[None]:
    """Within the block, the folders of settled tables are noted, for whoever knows when they may go."""
    token = _recorded.set(paths)
    try:
        yield
    finally:
        _recorded.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete settled tables that no later plan reads."""
    for folder in paths:
        path, files = _files(spark, folder)
        files.delete(path, True)
