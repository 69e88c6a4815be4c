"""Statistics of site pairs in the same hour, by distance."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nivalis.functions.physics import EARTH_RADIUS, haversine, planar
from nivalis.operators.blocks import binned_pairs
from nivalis.tables import settle


def _with_distance(pairs: DataFrame, prefer_xy: bool) -> DataFrame:
    far = planar("x", "y", "x2", "y2") if prefer_xy else haversine("lon", "lat", "lon2", "lat2")
    return pairs.withColumn("distance", far)


def _cells_of(max_range: float, prefer_xy: bool) -> list[Column]:
    """Cells at least as wide as the range: of the plane, or of space around the unit sphere, which has
    neither poles nor a date line."""
    if prefer_xy:
        return [F.floor(F.col(c) / max_range).alias(f"c{k}") for k, c in enumerate(("x", "y"))]
    lon, lat = F.radians("lon"), F.radians("lat")
    place = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    # the chord of the range, and a little more for rounding; beyond half the globe one cell holds all
    chord = 2 * math.sin(max_range / EARTH_RADIUS / 2) * (1 + 1e-9) if max_range < math.pi * EARTH_RADIUS else 4.0
    return [F.floor(p / chord).alias(f"c{k}") for k, p in enumerate(place)]


def same_hour_pairs(df: DataFrame, value: str, max_range: float, by_region: bool = False, prefer_xy: bool = True, key: str = "site", other: str | None = None) -> DataFrame:
    """Pairs of sites in one hour closer than max_range (planar if prefer_xy, else on the great circle),
    once each, with their values e, e2. Sites meet by hour and by cells as wide as the range, so an hour
    with many sites is dealt over its cells. A site looks into its own cell and into those neighbours
    that come after it, so each pair of cells meets once. Rows without a value are left out; with an
    `other` value (o, o2), rows without both."""
    cols = ["x", "y"] if prefer_xy else ["lon", "lat"]
    keys = ["hour", *(["region"] if by_region else [])]
    carried = {"e": value} | ({"o": other} if other else {})
    base = df.dropna(subset=cols).dropna("all", subset=list(carried.values()))
    base = base.select(F.date_trunc("hour", "time").alias("hour"), *(["region"] if by_region else []), key, *(F.col(v).alias(c) for c, v in carried.items()), *cols)
    cells = _cells_of(max_range, prefer_xy)
    names = [f"c{k}" for k in range(len(cells))]
    placed = base.select("*", *cells)
    twice = {key: "k2"} | {c: f"{c}2" for c in (*carried, *cols)}
    right = placed.select(*keys, *names, *(F.col(c).alias(d) for c, d in twice.items()))
    after = [step for step in product((-1, 0, 1), repeat=len(cells)) if step >= (0,) * len(cells)]
    around = F.array(*(F.struct(*((F.col(n) + d).alias(n) for n, d in zip(names, step, strict=True)), F.lit(any(step)).alias("_next")) for step in after))
    left = placed.select(*base.columns, F.explode(around).alias("_c")).select(*base.columns, "_c.*")
    met = left.join(right, [*keys, *names]).filter(F.when(F.col("_next"), F.col(key) != F.col("k2")).otherwise(F.col(key) < F.col("k2")))
    turned = F.col(key) > F.col("k2")  # the smaller key comes first
    out = met.select(*keys, *(F.when(turned, F.col(d)).otherwise(F.col(c)).alias(c) for c, d in twice.items()), *(F.when(turned, F.col(c)).otherwise(F.col(d)).alias(d) for c, d in twice.items()))
    return _with_distance(out, prefer_xy).filter(F.col("distance") < max_range)


def variogram_of_pairs(pairs: DataFrame, max_range: float, n_bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean of half the squared difference per distance bin; empty bins are kept, with null."""
    width = max_range / n_bins
    placed = pairs.withColumn("bin", F.floor(F.col("distance") / width).cast("int"))
    half = (F.col("e") - F.col("e2")) * (F.col("e") - F.col("e2")) / 2.0
    made = placed.groupBy(*by, "bin").agg(F.avg(half).alias("gamma"), F.count("*").alias("n_pairs"))
    frame = pairs.select(*by).distinct() if by else pairs.sparkSession.range(1).select()
    return _all_bins(made, frame, width, n_bins, by)


def _all_bins(made: DataFrame, frame: DataFrame, width: float, n_bins: int, by: Sequence[str]) -> DataFrame:
    """Bins of every group of the frame, empty ones too."""
    every = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    out = every.join(made, [*by, "bin"], "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    return out.withColumn("lag", (F.col("bin") + 0.5) * width)


def field_variogram(df: DataFrame, field: str, max_range: float = 10_000, n_bins: int = 20, by_region: bool = False, co_available: str | None = None, prefer_xy: bool = True) -> DataFrame:
    kept, by = df.dropna(subset=[co_available]) if co_available else df, ["region"] if by_region else []
    # two sites meet in many hours, so no meeting becomes a row, see blocks.py
    made = settle(binned_pairs(kept, field, max_range, n_bins, by, plane=prefer_xy), "bins")
    return _all_bins(made, made.select(*by).distinct() if by else df.sparkSession.range(1).select(), max_range / n_bins, n_bins, by)


def semivariogram(df: DataFrame, obs: str, model: str, **settings) -> DataFrame:
    """Of the residual model - obs."""
    return field_variogram(df.withColumn("_residual", F.col(model) - F.col(obs)), "_residual", **settings)


def sampled_semivariogram(df: DataFrame, obs: str, model: str, n_hours: int = 100, pairs_per_hour: int = 5000, seed: int = 0, max_range: float = 10_000, n_bins: int = 20) -> DataFrame:
    """A sampling operator: n_hours hours and in each at most pairs_per_hour pairs, by hash."""
    hour = F.date_trunc("hour", "time")
    hours = df.select(hour.alias("hour")).distinct().orderBy(F.xxhash64("hour", F.lit(seed)), "hour").limit(n_hours)
    kept = df.withColumn("hour", hour).join(hours, "hour", "left_semi").withColumn("_residual", F.col(model) - F.col(obs))
    pairs = same_hour_pairs(kept, "_residual", max_range)
    order = Window.partitionBy("hour").orderBy(F.xxhash64("hour", "site", "k2", F.lit(seed)), "site", "k2")
    few = pairs.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= pairs_per_hour)
    return variogram_of_pairs(few, max_range, n_bins)


def attach_obs_variogram(err: DataFrame, obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Error and observation variograms side by side, joined on the bin number."""
    names = lambda df, p: df.select(*by, "bin", *(["lag"] if p == "err" else []), F.col("gamma").alias(f"gamma_{p}"), F.col("n_pairs").alias(f"{p}_count"))
    return names(err, "err").join(names(obs, "obs"), [*by, "bin"], "left")


def error_and_obs_variograms(df: DataFrame, obs: str, model: str, max_range: float = 10_000, n_bins: int = 20, by_region: bool = False, prefer_xy: bool = True) -> DataFrame:
    """What attach_obs_variogram gives for the residual and the observation of one table, from one
    table of pairs: (bin, lag, gamma_err, gamma_obs, err_count, obs_count)."""
    pairs = same_hour_pairs(df.withColumn("_residual", F.col(model) - F.col(obs)), "_residual", max_range, by_region, prefer_xy, other=obs)
    width, by = max_range / n_bins, ["region"] if by_region else []
    half = lambda c: (F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) / 2.0
    made = pairs.groupBy(*by, F.floor(F.col("distance") / width).cast("int").alias("bin")).agg(
        F.avg(half("e")).alias("gamma_err"), F.avg(half("o")).alias("gamma_obs"), F.count(half("e")).alias("err_count"), F.count(half("o")).alias("obs_count")
    )
    frame = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("err_count", "obs_count")}
    return every.join(made, [*by, "bin"], "left").withColumns(counts | {"lag": (F.col("bin") + 0.5) * width})


def scale_skill(df: DataFrame) -> DataFrame:
    """Ratio of error to observed variance by scale, skill 1 - ratio, and the RMSE of pair differences."""
    ratio = F.when(F.col("gamma_obs") > 0, F.col("gamma_err") / F.col("gamma_obs"))
    return df.withColumns({"ratio": ratio, "skill": 1 - ratio, "pair_rmse": F.sqrt(2 * F.col("gamma_err"))})


def site_demeaned_residuals(df: DataFrame, obs: str, model: str, name: str) -> DataFrame:
    """Observation plus the residual less its site mean."""
    means = df.groupBy("site").agg(F.avg(F.col(model) - F.col(obs)).alias("_m"))
    return df.join(means, "site").withColumn(name, F.col(obs) + (F.col(model) - F.col(obs) - F.col("_m"))).drop("_m")
