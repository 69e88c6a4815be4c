"""Cases that every operator must take: ids beyond 2^53 beside a null, repeated rows, very long and
empty texts, nulls in all columns, empty tables, columns of clashing names."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nivalis.llm import chat_format, decontaminate, jaccard_join, language_id, language_model, media, pieces, substring_dedup, token_counts, toxicity

BIG = 1 << 53
CLASH = ["row", "id", "node", "band", "u", "v", "shard", "kind", "a", "b", "key", "n", "word", "part", "same", "score", "begins", "items", "conv"]


def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))


def bench(docs):
    return docs.filter("doc_id = 5").select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 120).alias("text"))


OPERATORS = {
    "op1": lambda d: media.edited_copies(d.withColumn("text", F.col("text").cast("binary")), "doc_id", "text"),
    "op2": lambda d: toxicity.held_out_scores(d, labels(d), min_docs=1),
    "op3": jaccard_join.near_duplicates,
    "op4": lambda d: substring_dedup.strip_repeats(d, window=10, phrase=3),
    "op5": lambda d: pieces.encode(d, public_tokenizers.path("piece_bpe_32k.model")),
    "op6": lambda d: token_counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
    "op7": lambda d: language_model.held_out_scores(d, vocabulary=16, width=4),
    "op8": lambda d: chat_format.read_back(chat_format.prefix_examples(d.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text", "row", "part"))),
    "op9": language_id.held_out_predictions,
    "op10": lambda d: decontaminate.matches(d, bench(d), block_bytes=50),
}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["sun", "moon", "Über", "tree", "x1", "long", "9"]) for _ in range(n))
    rows = [(BIG + 1, say(30), "en"), (BIG + 3, say(30), "de"), (None, say(30), "en"), (5, say(40_000), "en"), (6, "", "de"), (7, None, None), (8, " \n", "de")]
    rows += [rows[0], rows[2], (5, say(12), "de"), *((k, say(25), "en" if k % 2 else "de") for k in range(20, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = df.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}).withColumns({c: F.lit("x") for c in CLASH})
    return df.coalesce(1).cache()  # one batch holds nulls and large ids


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_and_rows_survive(name, table):
    out = OPERATORS[name](table)
    key = "conv_id" if name == "op8" else "doc_id"
    got, want = Counter(r[0] for r in out.select(key).collect()), Counter(r[0] for r in table.select("doc_id").collect())
    assert set(got) == set(want) if name == "op8" else got == want
    assert dict(out.dtypes)[key] == "bigint"
    again = OPERATORS[name](table.limit(0))
    assert again.columns == out.columns and again.count() == 0


def test_the_pipeline_takes_nulls_and_empty_tables(spark, table):
    d = "/root/testdata/sf0.001"
    for docs in (table.select(corpus_pipeline.COLUMNS), table.select(corpus_pipeline.COLUMNS).limit(0)):
        kept = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, d)
            if name != "pieces":
                assert docs.columns == corpus_pipeline.COLUMNS
            assert docs.count() <= kept
            kept = docs.count()
    assert kept == 0


def test_the_pipeline_keeps_a_null_id_with_a_text_of_its_own(spark, table):
    docs = table.select(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    ids = Counter(r.doc_id for r in docs.collect())
    assert ids[None] == 1 and ids[BIG + 1] == 1 and ids[BIG + 3] == 1 and not ids[6] and not ids[7]
