"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nivalis.llm.tables import discard, settle


#: Parts into which the edges of one node are dealt; a hot node's edges lie in that many tasks.
_PARTS = 32


def with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v, ...) with m, the smallest v of their u, and n, the edges of u. A node may have a
    third of all edges: they are dealt by (u, part), and of each part only its smallest v and its
    count meet the others."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(_PARTS)))
    parts = dealt.groupBy("u", "part").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.sum("n").alias("n"), F.collect_list("part").alias("parts"))
    back = least.select("u", "m", "n", F.explode("parts").alias("part"))
    return dealt.join(back, ["u", "part"]).drop("part")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = F.when(F.col("v") == F.col("m"), F.struct("u", F.col("m").alias("v"))).otherwise(F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return with_least(down).select(moved.alias("e")).select("e.u", "e.v").distinct()


def _seal(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge, from edges (u, v); the component is its
    smallest node. Alternates large-star and small-star rounds until the edges stand still; only
    row counts and checksums reach the driver. Loops and repeated edges do no harm."""
    now = settle(edges.select("u", "v").filter("u != v").distinct(), "edges")
    seal = _seal(now)
    while seal[0]:
        star = settle(_large_star(now), "edges")
        after = settle(_small_star(star), "edges")
        discard(now, star)
        now, before = after, seal
        seal = _seal(now)
        if seal == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
