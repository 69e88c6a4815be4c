"""Hourly, daily and climatological aggregates, summaries and histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nivalis.operators.ranges import LARGE, before_piece, join_groups, medians, quantiles, with_piece
from nivalis.tables import settle

from nivalis.functions.timecols import day_of_year, hour_of_year


def hourly_median(df: DataFrame, values: Sequence[str], by: Sequence[str] = ("site",), ident: str | None = None) -> DataFrame:
    """Median of every value per key and hour, and the least identifier."""
    hour = F.date_trunc("hour", "time").alias("time")
    ids = [F.min(ident).alias(ident)] if ident else []
    return df.groupBy(*by, hour).agg(*(F.median(v).alias(v) for v in values), *ids)


def site_means(df: DataFrame, cols: Sequence[str] = ("x", "y", "lon", "lat")) -> DataFrame:
    return df.groupBy("site").agg(*(F.avg(c).alias(c) for c in cols))


def time_and_cell_means(df: DataFrame, value: str, cell: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Means over cells per time and over times per cell, in one pass; `level` tells which."""
    sets = [[F.col("time")], [F.col(c) for c in cell]]
    out = df.groupingSets(sets, "time", *cell).agg(F.avg(value).alias(value), F.grouping("time").alias("_g"))
    return out.withColumn("level", F.when(F.col("_g") == 0, "time").otherwise("cell")).drop("_g")


def daily_mean(df: DataFrame, values: Sequence[str], by: Sequence[str] = ("region", "site")) -> DataFrame:
    return df.groupBy(*by, F.to_date("time").alias("date")).agg(*(F.avg(v).alias(v) for v in values))


def daily_min_mean_max(df: DataFrame, values: Sequence[str], by: str = "region") -> DataFrame:
    stats = {"min": F.min, "mean": F.avg, "max": F.max}
    return df.groupBy(by, F.to_date("time").alias("date")).agg(*(f(v).alias(f"{v}_{s}") for v in values for s, f in stats.items()))


def _climatology(daily: DataFrame, by: str, drop_feb29: bool) -> DataFrame:
    cols = [c for c in daily.columns if c not in (by, "date")]
    named = daily.withColumn("doy", day_of_year("date", drop_feb29)).filter("doy is not null")
    return named.groupBy(by, "doy").agg(*(F.avg(c).alias(c) for c in cols))


def daily_climatology(df: DataFrame, values: Sequence[str], by: str = "region", drop_feb29: bool = True) -> DataFrame:
    """Daily least, mean and largest value, averaged over years by day of year."""
    return _climatology(daily_min_mean_max(df, values, by), by, drop_feb29)


def spatial_range_hourly(df: DataFrame, values: Sequence[str], by: str = "region") -> DataFrame:
    return df.groupBy(by, F.date_trunc("hour", "time").alias("time")).agg(*((F.max(v) - F.min(v)).alias(v) for v in values))


def spatial_range_daily(df: DataFrame, values: Sequence[str], by: str = "region", within_day: str = "mean") -> DataFrame:
    if within_day not in ("mean", "max"):
        raise ValueError("within_day must be mean or max")
    f = F.avg if within_day == "mean" else F.max
    return spatial_range_hourly(df, values, by).groupBy(by, F.to_date("time").alias("date")).agg(*(f(v).alias(v) for v in values))


def spatial_range_climatology(df: DataFrame, values: Sequence[str], by: str = "region", within_day: str = "mean", drop_feb29: bool = True) -> DataFrame:
    return _climatology(spatial_range_daily(df, values, by, within_day), by, drop_feb29)


def hour_of_year_summary(df: DataFrame, values: Sequence[str], by: str = "region") -> DataFrame:
    stats = {"min": F.min, "mean": F.avg, "max": F.max}
    named = df.withColumn("hoy", hour_of_year("time")).filter("hoy is not null")
    return named.groupBy(by, "hoy").agg(*(f(v).alias(f"{v}_{s}") for v in values for s, f in stats.items()))


def spatial_anomaly(df: DataFrame, value: str, time: Sequence[str] = ("time",), large: int = LARGE) -> DataFrame:
    """Value less the median over all cells of its time. A time may have any number of cells."""
    middle = medians(df, value, list(time), "_m", large)
    return df.join(middle, list(time)).withColumn("anomaly", F.col(value) - F.col("_m")).drop("_m")


def median_anomaly_map(df: DataFrame, value: str, cell: Sequence[str], time: Sequence[str] = ("time",), large: int = LARGE) -> DataFrame:
    named = df.withColumn("anomaly", F.col(value))  # as many values, but for null times
    return medians(spatial_anomaly(df, value, time, large), "anomaly", list(cell), "anomaly", large, named)


def temporal_anomaly(df: DataFrame, value: str, cell: Sequence[str]) -> DataFrame:
    """Value less its cell's median of the calendar month."""
    named = df.withColumn("month", F.month("time"))
    usual = medians(named, value, [*cell, "month"], "_m")
    return named.join(usual, [*cell, "month"]).withColumn("anomaly", F.col(value) - F.col("_m")).drop("_m")


def season(time: str = "time"):
    return F.get(F.array(*map(F.lit, ("DJF", "MAM", "JJA", "SON"))), F.floor((F.month(time) % 12) / 3).cast("int"))


def seasonal_anomaly_map(df: DataFrame, value: str, cell: Sequence[str]) -> DataFrame:
    placed = spatial_anomaly(df, value).withColumn("season", season())
    return medians(placed, "anomaly", ["season", *cell], "anomaly", like=df.withColumns({"season": season(), "anomaly": F.col(value)}))


def monthly_site_error(df: DataFrame, obs: str, models: Sequence[str]) -> DataFrame:
    return df.groupBy(F.month("time").alias("month"), "site").agg(*(F.avg(F.col(m) - F.col(obs)).alias(m) for m in models))


def monthly_metrics(df: DataFrame, obs: str, models: Sequence[str]) -> DataFrame:
    """From means per month and site: mean error, MAE, RMSE and R per month and model."""
    from nivalis.functions.skill import summarize_regression

    means = df.groupBy(F.month("time").alias("month"), "site").agg(*(F.avg(c).alias(c) for c in (obs, *models)))
    return summarize_regression(means, obs, models, ["month"], ["Bias", "MAE", "RMSE", "R"])


def error_summary(df: DataFrame, obs: str, models: Sequence[str]) -> DataFrame:
    e = F.col("yhat") - F.col(obs)
    return df.unpivot([obs], list(models), "model", "yhat").groupBy("model").agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"))


def histogram(df: DataFrame, col: str, bins: int, lo: float, hi: float, by: Sequence[str] = (), density: bool = False) -> DataFrame:
    """Equal-width counts, the last bin closed on the right, empty bins present."""
    width = (hi - lo) / bins
    inside = df.filter(F.col(col).between(lo, hi))
    counted = inside.groupBy(*by, F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = every.join(counted, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("left", F.lit(lo) + F.col("bin") * width)
    if density:
        total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
        out = out.withColumn("density", F.try_divide("n", total * width))
    return out


def hist2d(df: DataFrame, x: str, y: str, n_edges: int = 50) -> DataFrame:
    """Counts on shared edges from the least value - 0.5 to the largest + 0.5."""
    ends = df.agg((F.least(F.min(x), F.min(y)) - 0.5).alias("_lo"), (F.greatest(F.max(x), F.max(y)) + 0.5).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / (n_edges - 1)
    place = lambda c: F.least(F.floor((F.col(c) - F.col("_lo")) / step), F.lit(n_edges - 2)).cast("int")
    return df.dropna(subset=[x, y]).crossJoin(F.broadcast(ends)).groupBy(place(x).alias("bx"), place(y).alias("by")).agg(F.count("*").alias("n"))


def linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def box_stats(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Count and exact quartiles; groups may be large."""
    return quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, group)


def all_and_by_region(df: DataFrame, *aggs, by: str = "region") -> DataFrame:
    """Each statistic for every region and for all."""
    out = df.groupingSets([[], [F.col(by)]], by).agg(*aggs, F.grouping(by).alias("_g"))
    return out.withColumn(by, F.when(F.col("_g") == 1, "all").otherwise(F.col(by))).drop("_g")


def top_groups(df: DataFrame, group: str, metric: str, k: int = 10, sort_by: str = "median") -> DataFrame:
    """The k largest groups, ordered by median, mean or name. Medians are exact and taken range by
    range, for the k groups only, so no task holds a group."""
    stats = df.groupBy(group).agg(F.count(metric).alias("count"), F.avg(metric).alias("mean"))
    top = settle(stats.orderBy(F.desc("count"), group).limit(k), "top")
    own = join_groups(df.select(group, metric), top.select(group, F.lit(True).alias("_in")), [group]).filter("_in")
    middle = quantiles(own.drop("_in"), metric, {"median": 0.5}, [group]).select(group, "median")
    out = join_groups(top, middle, [group]).select(group, "count", "median", "mean")
    return out.orderBy({"median": "median", "mean": "mean", "name": group}[sort_by], group)


def density_curve(df: DataFrame, group: str, metric: str, bins: int = 200, sigma: float = 8.0) -> DataFrame:
    """Histogram of each group over the shared range, smoothed by a Gaussian, scaled to a peak of 1."""
    kept = df.select(group, F.col(metric).alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = kept.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 1).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 1).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = kept.crossJoin(F.broadcast(ends)).select(group, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = placed.groupBy(group, "bin").agg(F.count("*").alias("n"))
    reach = min(401, 2 * bins + 1) // 2
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    kernel = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: k)
    spread = counts.select(group, F.explode(F.transform(kernel, lambda k: F.struct((F.col("bin") + k).alias("bin"), (F.col("n") * F.exp(-0.5 * F.pow(k / sigma, 2)) / sum(weights)).alias("w")))).alias("s"))
    smooth = spread.select(group, "s.bin", "s.w").filter(F.col("bin").between(0, bins - 1)).groupBy(group, "bin").agg(F.sum("w").alias("w"))
    return smooth.select(group, "bin", F.try_divide("w", F.max("w").over(Window.partitionBy(group))).alias("density"))


def trial_summary(trials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The best trial, and every trial with the best score so far."""
    best = trials.agg(F.min("value").alias("value"), F.min_by("number", F.struct("value", "number")).alias("number"))
    placed = before_piece(with_piece(trials, "number"), F.min("value"), F.min("_part"))
    order = Window.partitionBy("_piece").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.least(F.min("value").over(order), "_before")
    return best, placed.withColumn("best_so_far", so_far).drop("_piece", "_before")


def time_coverage(df: DataFrame, by: str = "region") -> DataFrame:
    return df.groupBy(by).agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count("*").alias("n"))
