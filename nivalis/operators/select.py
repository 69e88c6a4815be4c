"""Projections, filters, selection and sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONTH_GROUPS = {"ALL": tuple(range(1, 13)), "SUMMER": (5, 6, 7, 8, 9)}


def valid_readings(df: DataFrame) -> DataFrame:
    return df.filter(F.col("error_tomst") == 0).drop("error_tomst")


def exclude_box(df: DataFrame, area: str, col: str, lo: float, hi: float, area_col: str = "region") -> DataFrame:
    """Drop rows of one area whose coordinate lies strictly between lo and hi."""
    inside = (F.col(area_col) == area) & (F.col(col) > lo) & (F.col(col) < hi)
    return df.filter(~F.coalesce(inside, F.lit(False)))


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(subset) if subset else None)


def drop_empty_columns(df: DataFrame, within: str, value_cols: Sequence[str]) -> DataFrame:
    """Per group, rows that are null in no column that the group has at all."""
    from nivalis.tables import settle

    # written, so that the planner knows its size and need not sort the rows by group for the join
    counts = settle(df.groupBy(within).agg(*(F.count(c).alias(f"_n_{c}") for c in value_cols)), "counts")
    whole = F.lit(True)
    for c in value_cols:
        whole = whole & (F.col(c).isNotNull() | (F.col(f"_n_{c}") == 0))
    return df.join(counts, within).filter(whole).drop(*(f"_n_{c}" for c in value_cols))


def bbox(points: DataFrame, margin: float = 500.0, by: str = "region") -> DataFrame:
    return points.groupBy(by).agg(
        (F.min("x") - margin).alias("x0"), (F.max("x") + margin).alias("x1"), (F.min("y") - margin).alias("y0"), (F.max("y") + margin).alias("y1")
    )


def clip_to_box(grid: DataFrame, box: DataFrame, by: str = "region") -> DataFrame:
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return grid.join(box, by).filter(inside).drop("x0", "x1", "y0", "y1")


def _complete(cols: Sequence[str]):
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def complete_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.filter(_complete(cols))


def complete_mask(df: DataFrame, cols: Sequence[str], name: str = "mask") -> DataFrame:
    return df.withColumn(name, F.when(_complete(cols), 1))


def half_plane_mask(df: DataFrame, p1: tuple[float, float], p2: tuple[float, float], cols: Sequence[str]) -> DataFrame:
    """Complete cells below the line through two points."""
    slope = (p2[1] - p1[1]) / (p2[0] - p1[0])
    return df.filter((F.col("y") < slope * F.col("x") + (p1[1] - slope * p1[0])) & _complete(cols))


def thin_grid(df: DataFrame, max_points: int = 130_000) -> DataFrame:
    """Every k-th row and column, k the smallest stride that leaves at most max_points cells of the
    full rectangle. Needs integer places iy, ix."""
    span = df.agg(F.min("iy"), F.max("iy"), F.min("ix"), F.max("ix")).first()
    if span[0] is None:
        return df
    rows, cols = span[1] - span[0] + 1, span[3] - span[2] + 1
    k = 1
    while -(-rows // k) * -(-cols // k) > max_points:
        k += 1
    return df.filter(((F.col("iy") - span[0]) % k == 0) & ((F.col("ix") - span[2]) % k == 0))


def select_time(df: DataFrame, times: DataFrame) -> DataFrame:
    return df.join(times.select("time").distinct(), "time", "left_semi")


def padded_month_range(spark: SparkSession, year: int, month: int, pad: int = 4) -> DataFrame:
    """Hours of a month and `pad` hours to either side."""
    begin = f"timestamp'{year:04d}-{month:02d}-01 00:00:00'"
    return spark.sql(
        f"SELECT explode(sequence({begin} - interval {pad} hours, "
        f"add_months({begin}, 1) + interval {pad - 1} hours, interval 1 hour)) AS time"
    )


def hash_order(keys: Sequence[str], seed: int):
    """A random-looking order that engines agree on."""
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))


def site_sample(df: DataFrame, n: int = 100, seed: int = 99, by: str = "region", key: str = "site") -> DataFrame:
    """At most n sites of each region, by hash."""
    order = Window.partitionBy(by).orderBy(hash_order([key], seed), key)
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).drop("_k")


def row_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 99) -> DataFrame:
    return df.orderBy(hash_order(keys, seed), *keys).limit(n)


def min_distance_sample(df: DataFrame, distance: float, key: str = "site", seed: int = 99) -> DataFrame:
    """Points thinned so that no two kept are closer than `distance`, and every dropped one is close
    to a kept one: in each round a point whose priority beats all undecided neighbours is kept and its
    neighbours go, until none is undecided. Every round decides the best of all undecided points at
    least. Neighbours meet by grid cell, so the join is an equi join."""
    from nivalis.tables import settle

    cell = lambda c: F.floor(F.col(c) / distance)
    points = settle(df.select(key, "x", "y", hash_order([key], seed).alias("p")), "points")
    near = points.select(F.col(key).alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("p").alias("p2"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.array(*(F.struct((cell("x") + a).alias("cx"), (cell("y") + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    pairs = points.select("*", F.explode(around).alias("c")).select(key, "p", "x", "y", "c.cx", "c.cy").join(near, ["cx", "cy"])
    pairs = pairs.filter((F.col(key) != F.col("k2")) & (F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) < distance))
    pairs = settle(pairs.select(key, "p", "k2", "p2"), "pairs")
    open_, kept = points.select(key), None
    while True:
        live = pairs.join(open_, key, "left_semi").join(open_.withColumnRenamed(key, "k2"), "k2", "left_semi")
        beaten = live.filter(F.struct("p2", "k2") < F.struct("p", F.col(key))).select(key).distinct()
        won = settle(open_.join(beaten, key, "left_anti"), "won")
        kept = won if kept is None else kept.unionByName(won)
        close = pairs.join(won, key, "left_semi").select(F.col("k2").alias(key)).distinct()
        open_ = settle(open_.join(won, key, "left_anti").join(close, key, "left_anti"), "open")
        if open_.isEmpty():
            break
    return df.join(kept, key, "left_semi")


def month_group(df: DataFrame, groups: Mapping[str, Sequence[int]] = MONTH_GROUPS, time_col: str = "time") -> DataFrame:
    """Rows once for every named month set that holds their month."""
    named = F.array(*(F.struct(F.lit(g).alias("g"), F.array(*map(F.lit, m)).alias("m")) for g, m in groups.items()))
    month = F.month(time_col)
    return df.withColumn("month_group", F.explode(F.transform(F.filter(named, lambda s: F.array_contains(s["m"], month)), lambda s: s["g"])))


def require_coverage(df: DataFrame, min_count: int = 50) -> DataFrame:
    return df.filter((F.col("err_count") >= min_count) & (F.col("obs_count") >= min_count))


def clip_metric(df: DataFrame, cols: Sequence[str], lo: float = -2.0, hi: float = 15.0) -> DataFrame:
    """Values outside (lo, hi) become null."""
    return df.withColumns({c: F.when((F.col(c) > lo) & (F.col(c) < hi), F.col(c)) for c in cols})


def filter_by(df: DataFrame, wanted: Mapping[str, object], metric: str | None = None) -> DataFrame:
    """Rows that have the wanted value, or one of the wanted values, in each column."""
    for c, v in wanted.items():
        df = df.filter(F.col(c).isin(*v) if isinstance(v, list | tuple | set) else F.col(c) == v)
    return df.filter(F.col(metric).isNotNull() & ~F.isnan(metric)) if metric else df
