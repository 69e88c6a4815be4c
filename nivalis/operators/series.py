"""Time-series operators per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nivalis.operators.linepass import gaussian_weights, line_pass

LAGS = (-3, 0, 3, 6)


def lag_name(value: str, k: int) -> str:
    """`_-003` is three rows in the past, `_+003` three in the future."""
    return f"{value}_{'-' if k > 0 else '+'}{abs(k):03d}"


def lag_features(df: DataFrame, values: Sequence[str], by: Sequence[str], lags: Sequence[int] = LAGS, time_col: str = "time", by_time: bool = False) -> DataFrame:
    """Values shifted by k rows within a key, or by k hours with by_time (gaps then give nulls)."""
    if by_time:
        out = df
        for k in lags:
            moved = df.select(
                *by, (F.col(time_col) + F.expr(f"interval {k} hours")).alias(time_col), *(F.col(v).alias(lag_name(v, k)) for v in values)
            )
            out = out.join(moved, [*by, time_col], "left")
        return out
    order = Window.partitionBy(*by).orderBy(time_col)
    return df.withColumns({lag_name(v, k): F.lag(v, k).over(order) if k >= 0 else F.lead(v, -k).over(order) for v in values for k in lags})


def fill_gaps(df: DataFrame, values: Sequence[str], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last value before, else the first after, else 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({
        v: F.coalesce(F.last(v, True).over(before), F.first(v, True).over(after), F.lit(0.0)) for v in values
    })


def detrend(df: DataFrame, value: str, by: Sequence[str], time_col: str = "time") -> DataFrame:
    """Adds the least-squares line in time, its slope (per day) and intercept, and the residual."""
    days = F.unix_timestamp(time_col) / 86400.0
    line = df.groupBy(*by).agg(F.regr_slope(value, days).alias("slope"), F.regr_intercept(value, days).alias("intercept"))
    fit = F.col("intercept") + F.col("slope") * days
    return df.join(line, list(by)).withColumn("fit", fit).withColumn("residual", F.col(value) - F.col("fit"))


def gaussian_smooth_1d(df: DataFrame, value: str, by: Sequence[str], pos: str, sigma: float, mode: str = "wrap") -> DataFrame:
    """Gaussian mean along an integer position, nulls left out of it."""
    lo, weights = gaussian_weights(sigma)
    passed = line_pass(df.withColumns({"_num": F.coalesce(value, F.lit(0.0)), "_den": F.col(value).isNotNull().cast("double")}), list(by), pos, ["_num", "_den"], lo, weights, mode)
    smooth = passed.select(*by, pos, F.try_divide("_num", "_den").alias(f"{value}_smooth"))
    return df.join(smooth, [*by, pos])


def temperature_offsets(df: DataFrame, targets: Sequence[str] = ("T1", "T2", "T3"), base: str = "skt", kelvin: bool = True) -> DataFrame:
    """Targets less the coarse base temperature."""
    b = F.col(base) - (273.15 if kelvin else 0.0)
    return df.withColumns({f"{t}_offset": F.col(t) - b for t in targets})


def add_base(df: DataFrame, offsets: Sequence[str], base: str = "skt", kelvin: bool = True) -> DataFrame:
    """Inverse of temperature_offsets."""
    b = F.col(base) - (273.15 if kelvin else 0.0)
    return df.withColumns({o.removesuffix("_offset"): F.col(o) + b for o in offsets})
