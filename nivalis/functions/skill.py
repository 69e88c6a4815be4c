"""Skill metrics as aggregate columns over pairs of observation and model.

Each entry of METRICS maps (obs, mod) to a Column for use in agg(); pairs with a null on either
side do not count."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nivalis.operators.ranges import before_piece, with_piece

C = Column | str


def _pair(obs: C, mod: C) -> tuple[Column, Column]:
    o, m = (F.col(c) if isinstance(c, str) else c for c in (obs, mod))
    return F.when(m.isNotNull(), o), F.when(o.isNotNull(), m)


def mse(obs: C, mod: C) -> Column:
    o, m = _pair(obs, mod)
    return F.avg((m - o) * (m - o))


def rmse(obs: C, mod: C) -> Column:
    return F.sqrt(mse(obs, mod))


def mae(obs: C, mod: C) -> Column:
    o, m = _pair(obs, mod)
    return F.avg(F.abs(m - o))


def bias(obs: C, mod: C) -> Column:
    o, m = _pair(obs, mod)
    return F.avg(m - o)


def pearson(obs: C, mod: C) -> Column:
    """Null for a constant series (the built-in correlation raises there)."""
    o, m = _pair(obs, mod)
    return F.try_divide(F.covar_pop(o, m), F.stddev_pop(o) * F.stddev_pop(m))


def r_squared(obs: C, mod: C) -> Column:
    """Square of the correlation."""
    return pearson(obs, mod) * pearson(obs, mod)


def r2_score(obs: C, mod: C) -> Column:
    """One less the error sum over the spread of the observations; null if they are constant."""
    o, m = _pair(obs, mod)
    return 1 - F.try_divide(F.sum((m - o) * (m - o)), F.count(o) * F.var_pop(o))


def pseudo_huber(obs: C, mod: C, delta: float = 1.0) -> Column:
    o, m = _pair(obs, mod)
    return F.avg(delta * delta * (F.sqrt(1 + (m - o) * (m - o) / (delta * delta)) - 1))


METRICS: dict[str, Callable[[C, C], Column]] = {
    "RMSE": rmse, "MAE": mae, "Bias": bias, "R": pearson, "R2": r_squared, "MSE": mse, "R2SS": r2_score, "PHL": pseudo_huber,
}


def long_models(df: DataFrame, obs: str, models: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per key and model: columns keep, obs, model, yhat."""
    return df.unpivot([*keep, obs], list(models), "model", "yhat")


def summarize_regression(df: DataFrame, obs: str, models: Sequence[str], by: Sequence[str] = (), metrics: Sequence[str] = ("RMSE", "MAE", "Bias", "R", "R2")) -> DataFrame:
    """Metrics of each model and group; null groups are groups too."""
    long = long_models(df, obs, models, by)
    return long.groupBy("model", *by).agg(*(METRICS[m](obs, "yhat").alias(m) for m in metrics))


def compare_models(df: DataFrame, obs: str, models: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form of summarize_regression: one row per model, group and metric."""
    wide = summarize_regression(df, obs, models, by)
    return wide.unpivot(["model", *by], [c for c in wide.columns if c not in ("model", *by)], "metric", "value")


def event_skill(df: DataFrame, obs: str, models: Sequence[str], threshold: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Scores of the event value <= threshold; a score without a denominator is null, so F1 is null
    where precision or recall is, and where both are zero."""
    long = long_models(df, obs, models, by).dropna(subset=[obs, "yhat"])
    o, m = F.col(obs) <= threshold, F.col("yhat") <= threshold
    counted = long.groupBy("model", *by).agg(
        F.count_if(o & m).alias("tp"), F.count_if(~o & m).alias("fp"), F.count_if(o & ~m).alias("fn"), F.count_if(~o & ~m).alias("tn")
    )
    d = F.try_divide
    return counted.select(
        "model", *by, "tp", "fp", "fn", "tn",
        d("tp", F.col("tp") + F.col("fp")).alias("precision"),
        d("tp", F.col("tp") + F.col("fn")).alias("recall"),
        F.when(F.col("tp") > 0, d(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
        d(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
        d("tn", F.col("tn") + F.col("fp")).alias("tnr"),
    )


def nse(df: DataFrame, obs: str, mod: str, by: Sequence[str] = (), standard: bool = False) -> DataFrame:
    """One less the error sum over the sum about the mean of the model (of the observations if
    `standard`); each sum over its own rows."""
    centre = df.groupBy(*by).agg(F.avg(obs if standard else mod).alias("_c"))
    joined = df.join(centre, list(by)) if by else df.crossJoin(F.broadcast(centre))
    o, m = F.col(obs), F.col(mod)
    return joined.groupBy(*by).agg((1 - F.try_divide(F.sum((o - m) * (o - m)), F.sum((o - F.col("_c")) * (o - F.col("_c"))))).alias("NSE"))


def average_rank(df: DataFrame, col: str, by: Sequence[str], name: str) -> DataFrame:
    """Ranks with ties averaged. A group is ranked range by range, so it may be large."""
    placed = before_piece(with_piece(df, col, by), F.count("*"), F.sum("_part"), by)
    rank = F.rank().over(Window.partitionBy(*by, "_piece").orderBy(col))
    peers = F.count("*").over(Window.partitionBy(*by, "_piece", col))
    return placed.withColumn(name, F.coalesce("_before", F.lit(0)) + rank + (peers - 1) / 2.0).drop("_piece", "_before")


def spearman(df: DataFrame, obs: str, mod: str, by: Sequence[str]) -> DataFrame:
    """Correlation of ranks over complete pairs."""
    pairs = average_rank(average_rank(df.dropna(subset=[obs, mod]), obs, by, "_ro"), mod, by, "_rm")
    return pairs.groupBy(*by).agg(pearson("_ro", "_rm").alias("spearman"))


def row_correlation(series: DataFrame, y: DataFrame, key: str, on: str, value: str, target: str) -> DataFrame:
    """Correlation of every series (rows key, on, value) with one target series (on, target)."""
    return series.join(y.select(on, target), on).groupBy(key).agg(pearson(target, value).alias("R"))


def skill_table(df: DataFrame, obs: str, models: Sequence[str], groups=None) -> DataFrame:
    """Rounded RMSE and R per region, month group and model, over rows that are complete in the
    columns that the region has."""
    from nivalis.operators.select import MONTH_GROUPS, drop_empty_columns, month_group

    named = drop_empty_columns(month_group(df, groups or MONTH_GROUPS), "region", [obs, *models])
    out = summarize_regression(named, obs, models, ["region", "month_group"], ["RMSE", "R"])
    return out.select("region", "month_group", "model", F.round("RMSE", 1).alias("RMSE"), F.round("R", 2).alias("R"))


def metric_by(df: DataFrame, obs: str, models: Sequence[str], by: Sequence[str], metric: str = "RMSE") -> DataFrame:
    """A metric of every model side by side, per group."""
    return df.groupBy(*by).agg(*(METRICS[metric](obs, m).alias(m) for m in models))
