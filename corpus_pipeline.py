"""The corpus pipeline: documents through five operators, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the
shared folder and reads it again as the next stage's docs.  All but the last return the columns of
documents.

1. language_id     learns profiles from the stage's rows (those whose crc32(doc_id) mod 4 is not 2
                   and whose lang is known) and drops documents that have no language (`und`).
2. near_duplicates keeps the document with the smallest id of each group.
3. substring_dedup takes passages of 50 words out that an earlier document has; a document of
                   which nothing is left goes.
4. decontaminate   drops documents that hold a 10-word window of a benchmark item.
5. pieces          returns doc_id, n_pieces and the piece ids of the text.

A row is a document, whether or not another has its doc_id: stages 1 to 4 tell rows apart by a key
of their own.  Rows that repeat an id go by their own texts; a null doc_id counts as larger than any
other.  Empty tables stay empty.

The tables a stage works with are deleted when the next one begins, unless the documents that it is
given still come from them; a session runs one pipeline at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.llm import decontaminate, jaccard_join, language_id, pieces, substring_dedup
from nivalis.llm.tables import read, remainder, settle, shared_folder
from nivalis.tables import delete, recording

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of the tables that the latest stage works with.
_work: list[str] = []


def _stage(run: Stage) -> Stage:
    @wraps(run)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        needed = " ".join(docs.inputFiles()) if _work else ""
        gone = [path for path in _work if path.rpartition("/")[2] not in needed]
        delete(spark, gone)
        _work[:] = [path for path in _work if path not in gone]
        with recording(_work):
            return run(spark, docs, sf_dir)

    return wrapped


def _keyed(docs: DataFrame, ordered: bool = False) -> DataFrame:
    """The documents with a `row` of their own each, written so that it stays. If `ordered`, row
    grows with doc_id, and rows without an id come last."""
    docs = docs.select(COLUMNS)
    if ordered:
        docs = docs.orderBy(F.col("doc_id").asc_nulls_last())
    return settle(docs.withColumn("row", F.monotonically_increasing_id()), "rows", tidy=True)


@_stage
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language_id.fit_profiles(docs.filter(remainder("doc_id", 4) != 2), top=300)
    found = language_id.labelled(docs.select(COLUMNS), profiles)
    return found.filter(F.col("lang_pred") != language_id.UNDETERMINED).select(COLUMNS)


@_stage
def keep_one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = jaccard_join.near_duplicates(keyed, threshold=0.8, shingle=5, id_col="row").select("row", "class_id")
    by_id = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = found.join(keyed.select("row", "doc_id"), "row").groupBy("class_id").agg(F.min(by_id)["row"].alias("row"))
    return keyed.join(first, "row", "left_semi").select(COLUMNS)


@_stage
def take_repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs, ordered=True)
    found = substring_dedup.strip_repeats(keyed, window=50, id_col="row").filter("n_removed > 0").select("row", "kept")
    found = settle(found, "kept", tidy=True)
    joined = keyed.join(found, "row", "left").filter("kept is null or kept != ''")
    return joined.select(
        "doc_id",
        F.coalesce("kept", "text").alias("text"),
        "lang",
        "source",
        F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept").cast("long")).alias("n_chars"),
    )


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = decontaminate.matches(keyed, read(spark, sf_dir, "benchmark"), window=10, id_col="row")
    return keyed.join(found.filter(F.size("items") > 0).select("row"), "row", "left_anti").select(COLUMNS)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language_id", keep_languages),
    ("near_duplicates", keep_one_of_a_group),
    ("substring_dedup", take_repeats_out),
    ("decontaminate", drop_leaks),
    ("pieces", encode),
]

#: SQL cannot express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
