from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F

from nivalis.llm import language_id as L
from nivalis.llm.queries import op9_language_id


def brute_ngrams(text):
    padded = "_" + "".join(c if c.isalpha() else "_" for c in text.lower()) + "_"
    while "__" in padded:
        padded = padded.replace("__", "_")
    grams = [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]
    return Counter(g for g in grams if g != "_")


def test_counts_and_distances_equal_brute_force(spark, documents):
    rows = [(1, "Der Hund, der ABC!", "de"), (2, "the dog the THE", "en"), (3, "x ÿ œuf 中文", "fr"), (4, None, "fr"), (5, "the", None), (6, "Das", "de"), (7, "", "de"), (8, "ein!", "de")]
    table = documents(rows)
    want = {}
    for _, t, lang in rows:
        if t and lang:
            want.setdefault(lang, Counter()).update(brute_ngrams(t))
    got = {}
    for r in L.ngram_counts(table).collect():
        g = "".join(chr(r.ngram >> s & 0x1FFFFF) for s in (42, 21, 0) if r.ngram >> s & 0x1FFFFF)
        got.setdefault(r.lang, Counter())[g] = r.n
    assert got == want
    top = 6
    ranked = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))][:top] for lang, c in want.items()}
    profiles = L.fit_profiles(table, top=top)
    for text in ("the hund", "œuf", "der der dog"):
        own = [g for g, _ in sorted(brute_ngrams(text).items(), key=lambda x: (-x[1], x[0]))][:top]
        apart = {lang: sum(abs(r.index(g) - i) if g in r else top for i, g in enumerate(own)) for lang, r in sorted(ranked.items())}
        best = min(apart, key=apart.get)
        assert L.closest(text, profiles) == (best, 1 - apart[best] / (top * len(own)))


def test_no_letters_nulls_and_empty_tables(documents):
    table = documents([(1, "abc", "en"), (2, None, None), (3, "12 %%", "en"), (4, "", None), (None, "abc", "en"), (1, "abc", "en")])
    out = {(r.doc_id, r.lang_pred) for r in L.held_out_predictions(table).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= out and len(out) == 5
    assert L.held_out_predictions(table.limit(0)).count() == 0
    untrained = L.fit_profiles(table.filter("doc_id > 99"))
    assert L.identify(table, untrained).filter("lang_pred != 'und'").count() == 0


def test_held_out_accuracy(spark):
    out = op9_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = out.join(truth, "doc_id").filter("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] > 0.97


def test_query_equals_brute_force(spark):
    """Profiles and predictions again by dictionaries, for all documents of the smallest tables."""
    d, top = "/root/testdata/sf0.001", 300
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").collect()]
    counts = {}
    for i, t, lang in rows:
        if t and lang and crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(brute_ngrams(t))
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))][:top]
    ranked = {lang: {g: k for k, g in enumerate(order(c))} for lang, c in sorted(counts.items())}
    want = {}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            want[i] = (crc32(str(i).encode()) % 4 == 2, "und", 0.0)
            continue
        own = order(brute_ngrams(t))
        apart = {lang: sum(abs(r[g] - k) if g in r else top for k, g in enumerate(own)) for lang, r in ranked.items()}
        best = min(apart, key=apart.get)
        want[i] = (crc32(str(i).encode()) % 4 == 2, best, round(1 - apart[best] / (top * len(own)), 9))
    assert {r.doc_id: (r.held_out, r.lang_pred, round(r.score, 9)) for r in op9_language_id(spark, d).collect()} == want


def test_very_long_texts_and_repeated_rows(documents):
    rows = [(1, "der hund und die katze " * 60_000, "de"), (3, "the dog and the cat " * 3, "en"), (4, "der die und " * 50, None), (4, "der die und " * 50, None)]
    out = [(r.doc_id, r.lang_pred) for r in L.held_out_predictions(documents(rows)).collect()]
    assert sorted(out) == [(1, "de"), (3, "en"), (4, "de"), (4, "de")]
