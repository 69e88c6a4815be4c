"""Order statistics of large groups: rows are cut into ranges of about equal size, so that no task
holds a whole group, and what lies before a range is joined to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nivalis.tables import settle

PIECES = 64


def join_groups(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join of a table with a row a group; null keys meet."""
    if not by:
        return df.crossJoin(F.broadcast(groups))  # one row
    right = groups.withColumnsRenamed({b: f"_of_{b}" for b in by})
    met = F.lit(True)
    for b in by:
        met = met & df[b].eqNullSafe(right[f"_of_{b}"])
    return df.join(right, met, "left").drop(*(f"_of_{b}" for b in by))


def with_piece(df: DataFrame, value: str, by: Sequence[str] = (), pieces: int = PIECES) -> DataFrame:
    """Adds _piece, the range of each value within its group: equal values share one. Bounds are
    approximate quantiles, so ranges differ somewhat in size, which no result depends on."""
    shares = [k / pieces for k in range(1, pieces)]
    bounds = settle(df.groupBy(*by).agg(F.percentile_approx(value, shares, 1000).alias("_bounds")), "bounds")
    below = F.size(F.filter(F.array_distinct(F.coalesce("_bounds", F.array())), lambda b: b < F.col(value)))
    return join_groups(df, bounds, by).withColumn("_piece", F.coalesce(below, F.lit(0))).drop("_bounds")


def before_piece(placed: DataFrame, total: Column, over: Column, by: Sequence[str] = ()) -> DataFrame:
    """Adds _before: an aggregate of each piece, then aggregated over the group's earlier pieces."""
    parts = placed.groupBy(*by, "_piece").agg(total.alias("_part")).withColumn("_all", F.lit(1))
    earlier = Window.partitionBy(*by, "_all").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    return join_groups(placed, parts.withColumn("_before", over.over(earlier)).drop("_part", "_all"), [*by, "_piece"])


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, shares...): the number of values of each group and exact quantiles, linear between
    neighbours; null for a group without values."""
    counts = df.groupBy(*by).agg(F.count(value).alias("n"))
    placed = before_piece(with_piece(df.select(*by, value).dropna(subset=[value]), value, by), F.count("*"), F.sum("_part"), by)
    row = F.row_number().over(Window.partitionBy(*by, "_piece").orderBy(value)) - 1
    ranked = join_groups(placed.withColumn("_row", F.coalesce("_before", F.lit(0)) + row), counts, by)
    at = lambda share: (F.col("n") - 1) * F.lit(share)
    found = ranked.groupBy(*by).agg(
        *(F.max(F.when(F.col("_row") == end(at(p)), F.col(value))).alias(f"_{k}_{name}") for name, p in shares.items() for k, end in (("lo", F.floor), ("hi", F.ceil)))
    )
    part = lambda name, p: F.col(f"_lo_{name}") + (at(p) - F.floor(at(p))) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
    return join_groups(counts, found, by).select(*by, "n", *(part(name, p).alias(name) for name, p in shares.items()))


#: Values of a group beyond which its median is not left to one task.
LARGE = 1_000_000


def medians(df: DataFrame, value: str, by: Sequence[str], name: str, large: int = LARGE, like: DataFrame | None = None) -> DataFrame:
    """(by, name): exact medians. Groups of more than `large` values are taken range by range, the others
    in one aggregate, to the same result. `like` is a cheaper table with as many values a group."""
    sizes = (df if like is None else like).groupBy(*by).agg(F.count(value).alias("_n")).filter(F.col("_n") > large)
    sizes = settle(sizes.select(*by, F.lit(True).alias("_large")), "large")
    if sizes.isEmpty():
        return df.groupBy(*by).agg(F.median(value).alias(name))
    marked = join_groups(df.select(*by, value), sizes, by)
    few = marked.filter("_large is null").groupBy(*by).agg(F.median(value).alias(name))
    many = quantiles(marked.filter("_large").drop("_large"), value, {name: 0.5}, by)
    return few.unionByName(many.select(*by, name))
