"""The domain tables, laid over the star-schema test tables (see FIXTURES.md).

The texts run in Spark and in the checking engine, unchanged but for those in SPARK; `{name}` stands for
a base table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nivalis.tables import settle, size_of

TEXTS = {
    "sites": """SELECT s_suppkey AS site, r_name AS region, n_regionkey AS region_id,
       (s_suppkey % 10) * 1000e0 + n_regionkey * 100e0 AS x,
       floor(s_suppkey / 10e0) * 1000e0                AS y,
       68e0 + (s_suppkey % 37) / 20e0                  AS lat,
       21e0 + (s_suppkey % 91) / 13e0                  AS lon
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "readings": """SELECT event_id AS row_id, user_id AS site, event_type AS region, CAST(ts AS TIMESTAMP) AS time,
       CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS error_tomst,
       value / 5e0 - 7e0                             AS T3,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE value / 6e0 - 5e0 END AS T2,
       value / 8e0 - 3e0 + (event_id % 7)            AS T1
FROM {events}""",
    "skill": """SELECT s.region, s.site, CAST(l.l_shipdate AS TIMESTAMP) AS time, s.x, s.y, s.lat, s.lon,
       avg(l.l_extendedprice / 2000e0 - 26.5e0)                                 AS T3,
       avg(l.l_extendedprice / 2000e0 - 26.5e0 + (l.l_quantity - 25.5e0) / 3e0) AS gbt_T3,
       avg((l.l_extendedprice / 2000e0 - 26.5e0) * 0.8e0 + l.l_tax * 50e0)      AS lasso_T3,
       avg(CASE WHEN s.region_id IN (0, 3)
                THEN l.l_extendedprice / 2000e0 - 26.5e0 + (l.l_discount - 0.05e0) * 90e0 END) AS physical_T3,
       avg(l.l_extendedprice / 2000e0 - 26.5e0 + (l.l_partkey % 11) * 2e0 - 8e0) AS coarse_T3
FROM {lineitem} l JOIN {sites} s ON l.l_suppkey = s.site
GROUP BY s.region, s.site, CAST(l.l_shipdate AS TIMESTAMP), s.x, s.y, s.lat, s.lon""",
    "dem": """SELECT concat('R', CAST(CAST(floor(p_partkey / 1000e0) AS INT) AS VARCHAR(10))) AS region,
       CAST(floor((p_partkey % 1000) / 50e0) AS INT) AS iy, CAST(p_partkey % 50 AS INT) AS ix,
       -10e0 * floor((p_partkey % 1000) / 50e0) AS y, 10e0 * (p_partkey % 50) AS x,
       CASE WHEN p_partkey % 97 = 5 THEN NULL ELSE (p_retailprice - 900e0) + p_size * 3e0 END AS dem10m,
       p_size / 50e0 AS svf, (p_size % 7) - 3e0 AS mbi, (p_partkey % 13) / 13e0 AS norm_height,
       (p_partkey % 29) - 9e0 AS windexp500
FROM {part}""",
    "reanalysis": """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS time,
       65e0 + floor(c_nationkey / 5e0) * 2e0 AS lat, 20e0 + (c_nationkey % 5) * 2e0 AS lon,
       avg(263.15e0 + o_totalprice / 20000e0) AS t2m,
       avg(261.15e0 + o_totalprice / 20000e0) AS d2m,
       avg(273.15e0 + c_acctbal / 1000e0)     AS skt,
       sum(o_totalprice)                      AS ssrd,
       sum(o_totalprice) * 0.6e0              AS fdir
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
GROUP BY 1, 2, 3""",
}
#: The same rows for Spark with less to hold: lines are dealt by site and time over tasks of a bounded share of the
#: file before their means are taken, and the site's columns come after the aggregate.
SPARK = {
    "skill": """SELECT s.region, s.site, l.time, s.x, s.y, s.lat, s.lon,
       l.T3, l.gbt_T3, l.lasso_T3, CASE WHEN s.region_id IN (0, 3) THEN l.physical_T3 END AS physical_T3, l.coarse_T3
FROM (SELECT l_suppkey, time,
             avg(l_extendedprice / 2000e0 - 26.5e0)                                  AS T3,
             avg(l_extendedprice / 2000e0 - 26.5e0 + (l_quantity - 25.5e0) / 3e0)    AS gbt_T3,
             avg((l_extendedprice / 2000e0 - 26.5e0) * 0.8e0 + l_tax * 50e0)         AS lasso_T3,
             avg(l_extendedprice / 2000e0 - 26.5e0 + (l_discount - 0.05e0) * 90e0)   AS physical_T3,
             avg(l_extendedprice / 2000e0 - 26.5e0 + (l_partkey % 11) * 2e0 - 8e0)   AS coarse_T3
      FROM (SELECT /*+ REPARTITION({tasks}, l_suppkey, time) */ l_suppkey, CAST(l_shipdate AS TIMESTAMP) AS time, l_extendedprice, l_quantity, l_tax, l_discount, l_partkey
            FROM {lineitem} WHERE l_suppkey IS NOT NULL)
      GROUP BY l_suppkey, time) l
JOIN {sites} s ON l.l_suppkey = s.site""",
}
_BASE = {
    "sites": ("supplier", "nation", "region"),
    "readings": ("events",),
    "skill": ("lineitem", "sites"),
    "dem": ("part",),
    "reanalysis": ("orders", "customer"),
}


#: Bytes of the line file for each task that takes means.
_SHARE = 4_000_000


def _skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written, so that the planner knows its size and need not deal the lines anew for the join
    sites = settle(table(spark, sf_dir, "sites").distinct(), "sites")
    tasks = max(spark.sparkContext.defaultParallelism, size_of(spark, f"{sf_dir}/lineitem.parquet") // _SHARE)
    return spark.sql(SPARK["skill"].replace("{tasks}", str(tasks)), lineitem=table(spark, sf_dir, "lineitem"), sites=sites)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table or, under any other name, a base table."""
    if name == "skill":
        return _skill(spark, sf_dir)
    if name not in TEXTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(TEXTS[name], **{b: table(spark, sf_dir, b) for b in _BASE[name]})


def with_adapters(body: str, *names: str) -> str:
    """Reference SQL over domain tables: `body` is a SELECT, or further CTEs and a SELECT."""
    wanted = list(dict.fromkeys(x for n in names for x in (*(b for b in _BASE[n] if b in TEXTS), n)))
    ctes = [f"{n} AS ({TEXTS[n].replace('{', '').replace('}', '')})" for n in wanted]
    body = body.strip()
    head = "WITH " + ",\n".join(ctes)
    return f"{head}\n{body}" if body[:6].upper() == "SELECT" else f"{head},\n{body}"
