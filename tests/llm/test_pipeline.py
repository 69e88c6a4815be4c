import corpus_pipeline
import public_tokenizers
import sentencepiece
from test_decontaminate import brute as leaks
from test_jaccard_join import brute as groups
from test_substring_dedup import brute as repeats  # noqa: F401


def test_stages_equal_brute_force(spark):
    """Each stage's rows on sf0.001, from the rows its predecessor kept."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            assert set(kept) == {i for i, t in rows.items() if any(c.isalpha() for c in t or "")}
        elif name == "near_duplicates":
            assert set(kept) == {i for i, (c, _) in groups(list(rows.items())).items() if c == i}
        elif name == "substring_dedup":
            want = repeats(list(rows.items()), 50)
            assert set(kept) == {i for i, n, gone, _ in want if not gone or gone < n}
            assert all(kept[i] == rows[i] for i, _, gone, _ in want if not gone)
        else:
            assert set(kept) == {i for i, x in leaks(list(rows.items()), items, 10).items() if not x[-1]}
        rows, docs = kept, spark.createDataFrame(out.collect(), out.schema)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, d).collect()} == {i: library.encode(t or "") for i, t in rows.items()}


def test_rows_that_repeat_an_id_or_have_none_go_by_their_texts(spark):
    d = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{d}/benchmark.parquet").filter("size(split(text, ' ')) > 12").first().text
    plain = [" ".join(f"{w}{x}" for x in "abcdefghijklmnopqrstuvwxyz") for w in ("big", "dog", "tree", "lake")]
    long = " ".join(f"word{a}{b}" for a in "abcdefghij" for b in "abcdefgh")
    texts = [(1, plain[0]), (1, plain[1]), (1, item), (1, "12 34"), (2, plain[0]), (None, plain[2]), (None, plain[3]), (None, item), (None, "56 78"), (None, plain[1])]
    texts += [(5, long + " " + plain[0] * 9), (None, "other start " * 40 + long)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    by_name = dict(corpus_pipeline.STAGES)
    out = lambda name: sorted((r.doc_id or 0, r.text) for r in by_name[name](spark, docs, d).collect())
    want = lambda gone: sorted((i or 0, t) for k, (i, t) in enumerate(texts) if k not in gone)
    assert out("language_id") == want({3, 8})
    assert out("near_duplicates") == want({4, 7, 9})
    assert out("decontaminate") == want({2, 7})
    stripped = dict(enumerate(out("substring_dedup")))
    assert len(stripped) == len(texts) and not any("wordaa wordab" in t for i, t in stripped.values() if i == 0)
