"""Queries with their reference SQL, shaped alike on both sides: times as text, integers as 64 bits,
doubles rounded."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.sources.adapters import table, with_adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 7
#: Keeps decimal values off exact halves, where engines round apart.
_OFF_HALVES = 3.3e-09


def register(name: str, run: Callable, sql: str | None = None, adapters: Sequence[str] = (), keys: str = "", times: str = "", ints: str = "", vals: str = "", digits: int = DIGITS) -> None:
    """run(get) builds the DataFrame, get(name) being a domain or base table. The column lists are
    names separated by blanks. Without SQL the rows alone are checked."""
    keys_, times_, ints_, vals_ = (x.split() for x in (keys, times, ints, vals))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(lambda n: table(spark, sf_dir, n))
        return df.select(
            *(F.col(k) for k in keys_),
            *(F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias(t) for t in times_),
            *(F.col(i).cast("long").alias(i) for i in ints_),
            *((F.round(F.col(v).cast("double") + F.lit(_OFF_HALVES), digits) + F.lit(0.0)).alias(v) for v in vals_),
        )

    QUERIES[name] = query
    if sql is not None:
        shaped = ", ".join([
            *(f'"{k}"' for k in keys_),
            *(f"strftime(\"{t}\", '%Y-%m-%d %H:%M:%S') AS \"{t}\"" for t in times_),
            *(f'CAST("{i}" AS BIGINT) AS "{i}"' for i in ints_),
            *(f'CAST(round(CAST("{v}" AS DOUBLE) + {_OFF_HALVES!r}, {digits}) + 0e0 AS DOUBLE) AS "{v}"' for v in vals_),
        ])
        body = sql.strip()
        if body[:6].upper() == "SELECT":
            ORACLE[name] = with_adapters(f"SELECT {shaped} FROM ({body})", *adapters) if adapters else f"SELECT {shaped} FROM ({body})"
        else:  # CTEs, then the last SELECT after a line "--"
            ctes, _, last = body.rpartition("\n--\n")
            made = f"{ctes}\nSELECT {shaped} FROM ({last})"
            ORACLE[name] = with_adapters(made, *adapters) if adapters else f"WITH {made}"
