"""The live logger feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_hourly_readings(stream: DataFrame, values: Sequence[str] = ("T1", "T2", "T3"), late: str = "2 hours") -> DataFrame:
    """Hourly medians per site, put out when the watermark has passed the hour (append mode)."""
    hour = F.window("time", "1 hour")
    out = stream.withWatermark("time", late).groupBy("site", hour.alias("w")).agg(*(F.median(v).alias(v) for v in values))
    return out.select("site", F.col("w.start").alias("time"), *values)


def stream_enrich(stream: DataFrame, sites: DataFrame) -> DataFrame:
    """Valid readings with their site's coordinates (stream-static join)."""
    from nivalis.operators.interpolate import attach_site_coords
    from nivalis.operators.select import valid_readings

    return attach_site_coords(valid_readings(stream), sites)
