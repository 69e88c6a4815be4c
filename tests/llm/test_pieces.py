import random

import public_tokenizers
import pytest
import sentencepiece

from nivalis.llm import pieces as P
from nivalis.llm.queries import op5_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(9)
    bits = ["the", " ", "  ", " a", "tion", "é", "日本", "\n", "\t", "\r", "<0x0A>", "▁", "x" * 50, "ﬁ", "<s>", "🙂", "don't", " " * 20, "　"]
    return [None, "", " ", "   ", "a", " a ", *("".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(120))]


def test_ids_equal_the_library_and_decode_to_the_text(documents, library):
    rows = [(i, t, "en") for i, t in enumerate(texts())] + [(None, "null id tion", "en"), (3, "   ", "en")]
    for style in ("columns", "lattice"):
        out = P.decode(P.encode(documents(rows), PATH, style=style), PATH).collect()
        assert len(out) == len(rows)
        want = {i: t or "" for i, t, _ in rows}
        for r in out:
            assert r.ids == library.encode(want[r.doc_id]), want[r.doc_id]
            assert r.decoded == want[r.doc_id].replace("▁", " ")
    assert P.encode(documents(rows).limit(0), PATH).count() == 0


def test_viterbi_equals_brute_force(spark):
    model = P.load(PATH)
    score = {p: s for p, s, n in zip(model.pieces, model.scores, model.normal, strict=True) if n}
    unknown = min(score.values()) - 10

    def best(t):
        sums = [0.0]
        for e in range(1, len(t) + 1):
            options = [sums[b] + score[t[b:e]] for b in range(max(0, e - model.longest), e) if t[b:e] in score]
            sums.append(max(options + ([] if t[e - 1 : e] in score else [sums[e - 1] + unknown])))
        return sums[-1]

    odd = "\U000103c8"  # not in the vocabulary
    words = ["▁the", "▁nation", f"▁{odd}x", "▁inter", "é", "▁▁ab", "tionation"]
    units = spark.createDataFrame([(i, w, 1) for i, w in enumerate(words)], "unit long, text string, n long")
    for r in P.encode_units(units, PATH, "viterbi").collect():
        spelled = [model.pieces[i] for i in r.ids]
        got = sum(score.get(p, 0.0) for p in spelled if not p.startswith("<0x")) + unknown * r.text.count(odd)
        assert abs(got - best(r.text)) < 1e-6 and "".join(p for p in spelled if not p.startswith("<0x")) == r.text.replace(odd, "")


def test_columns_and_heap_give_the_library_ids(library, monkeypatch):
    words = sorted({w for t in texts() for w in (t or "").replace("▁", " ").split(" ") if w} | {"tion" * 30, "international"})
    for long, kept, places in ((40, 400_000, 500_000), (0, 400_000, 500_000), (1 << 20, 10, 30)):
        monkeypatch.setattr(P, "_LONG", long)
        monkeypatch.setattr(P, "_KEPT", kept)
        monkeypatch.setattr(P.columns, "_PLACES", places)
        encode = P.Encoder(PATH)
        for lo in range(0, len(words), 7):
            ids, sizes = encode(words[lo : lo + 7])
            assert ids.tolist() == [i for w in words[lo : lo + 7] for i in library.encode(w)]
            assert sizes.tolist() == [len(library.encode(w)) for w in words[lo : lo + 7]]


def test_lattice_gives_the_library_ids(spark, library):
    words = sorted({w for t in texts() for w in (t or "").replace("▁", " ").split(" ") if w} | {"tion" * 30, "international"})
    units = spark.createDataFrame([(i, "▁" + w, 1) for i, w in enumerate(words)], "unit long, text string, n long")
    out = P.encode_units(units, PATH, "merges").collect()
    assert len(out) == len(words) and all(r.ids == library.encode(words[r.unit]) for r in out)


def test_query_equals_the_library(spark, library):
    d = "/root/testdata/sf0.01"
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    out = op5_pieces(spark, d).collect()
    assert len(out) == len(want)
    for r in out:
        assert r.ids == library.encode(want[r.doc_id]) and r.n_pieces == len(r.ids)
