"""Bioclimatic indicators of temperature series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frost_hours(df: DataFrame, value: str, by: Sequence[str], threshold: float = 0.0) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.col(value) <= threshold).alias("frost_hours"))


def degree_hours(df: DataFrame, value: str, by: Sequence[str], base: float = 0.0) -> DataFrame:
    above = F.when(F.col(value).isNotNull(), F.greatest(F.col(value) - base, F.lit(0.0)))
    return df.groupBy(*by).agg(F.coalesce(F.sum(above), F.lit(0.0)).alias("degree_hours"))


def freeze_thaw_cycles(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str] = ("time",), threshold: float = 0.0) -> DataFrame:
    """Changes between frozen and not over consecutive values, nulls left out; null below 2 values."""
    frozen = F.col(value) <= threshold
    known = df.withColumn("_f", frozen).withColumn("_was", F.lag("_f").over(Window.partitionBy(*by, F.col(value).isNull()).orderBy(*order)))
    counted = F.count_if(F.col("_f").isNotNull() & F.col("_was").isNotNull() & (F.col("_f") != F.col("_was")))
    return known.groupBy(*by).agg(F.when(F.count(value) >= 2, counted).alias("freeze_thaw"))


def episodes_within(df: DataFrame, value: str, by: Sequence[str], lo: float, hi: float, order: Sequence[str] = ("time",)) -> DataFrame:
    """Maximal runs with lo <= value <= hi, a null ends a run: their number (null below 2) and mean length."""
    inside = F.coalesce(F.col(value).between(lo, hi), F.lit(False))
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_in", inside)
    marked = marked.withColumn("_run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, "_in").orderBy(*order)))
    runs = marked.groupBy(*by, "_in", "_run").agg(F.count("*").alias("_n"))
    counted = runs.groupBy(*by).agg(F.count_if("_in").alias("_k"), F.avg(F.when(F.col("_in"), F.col("_n"))).alias("episode_length"))
    return counted.select(*by, F.when(F.col("_k") >= 2, F.col("_k")).alias("episodes"), "episode_length")


def diurnal_amplitude(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    daily = df.groupBy(*by, F.to_date("time").alias("_d")).agg((F.max(value) - F.min(value)).alias("_a"))
    return daily.groupBy(*by).agg(F.avg("_a").alias("diurnal_amplitude"))


def warmth_and_coldness(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Sums of the monthly means above and (with changed sign) below zero."""
    monthly = df.groupBy(*by, F.date_trunc("month", "time").alias("_m")).agg(F.avg(value).alias("_t"))
    return monthly.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("_t") > 0, F.col("_t")).otherwise(0.0)), F.lit(0.0)).alias("summer_warmth"),
        (-F.coalesce(F.sum(F.when(F.col("_t") < 0, F.col("_t")).otherwise(0.0)), F.lit(0.0))).alias("winter_coldness"),
    )


INDICATORS = ("frost_hours", "degree_hours", "freeze_thaw", "episodes", "episode_length", "diurnal_amplitude", "summer_warmth", "winter_coldness", "mean_temp")


def indicators(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str] = ("time",), base: float = 0.0, threshold: float = 0.0, lo: float = -2.0, hi: float = 2.0) -> DataFrame:
    """All indicators at once: one pass over each group's rows in order marks changes and episode
    starts, then days, months and groups are aggregated one from the other. Null keys are a group."""
    v, by, before = F.col(value), list(by), Window.partitionBy(*by).orderBy(*order)
    frozen, inside = v <= threshold, F.coalesce(v.between(lo, hi), F.lit(False))
    was = F.last(frozen, True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    number = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    marked = df.select(
        *by, F.to_date("time").alias("_day"), v.alias("_v"), frozen.alias("_f"), inside.alias("_in"), (frozen != was).alias("_turn"),
        (inside & ~F.coalesce(F.lag(inside).over(before), F.lit(False))).alias("_start"),
    )
    days = marked.groupBy(*by, "_day").agg(
        F.sum("_v").alias("_sum"), F.count("_v").alias("_n"), (F.max("_v") - F.min("_v")).alias("_range"), number(F.col("_f")).alias("_frost"),
        F.sum(F.when(F.col("_v").isNotNull(), F.greatest(F.col("_v") - base, F.lit(0.0)))).alias("_degrees"),
        number(F.col("_turn")).alias("_turns"), number(F.col("_start")).alias("_starts"), number(F.col("_in")).alias("_ins"),
    )
    add = ["_sum", "_n", "_frost", "_degrees", "_turns", "_starts", "_ins"]
    months = days.groupBy(*by, F.date_trunc("month", "_day").alias("_month")).agg(
        *(F.sum(c).alias(c) for c in add), F.sum("_range").alias("_ranges"), F.count("_range").alias("_days")
    )
    mean = F.try_divide("_sum", "_n")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return months.groupBy(*by).agg(
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean_temp"),
        F.sum("_frost").alias("frost_hours"),
        whole("_degrees").alias("degree_hours"),
        F.when(F.sum("_n") >= 2, F.sum("_turns")).alias("freeze_thaw"),
        F.when(F.sum("_starts") >= 2, F.sum("_starts")).alias("episodes"),
        F.try_divide(F.sum("_ins"), F.sum("_starts")).alias("episode_length"),
        F.try_divide(F.sum("_ranges"), F.sum("_days")).alias("diurnal_amplitude"),
        whole(F.when(mean > 0, mean)).alias("summer_warmth"),
        (-whole(F.when(mean < 0, mean))).alias("winter_coldness"),
    )


def bioclim_summary(df: DataFrame, obs: str, models: Sequence[str], by: Sequence[str] = ("region", "site", "year"), months: Sequence[int] = tuple(range(1, 13)), **settings) -> DataFrame:
    """All indicators of the observation and of each model, and the models' biases (model less
    observation), per group: one row per group and series. Null keys are a group like others."""
    named = df.withColumn("year", F.year("time")).filter(F.month("time").isin(*months))
    long = named.unpivot([*by, "time"], [obs, *models], "series", "v")
    made = indicators(long, "v", [*by, "series"], **settings)
    series = Window.partitionBy(*by)  # a few rows a group
    truth = lambda i: F.max(F.when(F.col("series") == obs, F.col(i))).over(series)
    return made.withColumns({f"{i}_bias": F.when(F.col("series") != obs, F.col(i) - truth(i)) for i in INDICATORS})
