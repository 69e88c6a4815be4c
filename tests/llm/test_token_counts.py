import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nivalis.llm import token_counts as C
from nivalis.llm.queries import op6_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    bits = ["the ", "  ", "\n\n", "  ", "don't", "'", "ré", "<|endoftext|>", "<|endof", "1234", "aaaa", "%%", "　", "日本", " x", "\t"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(300))) for _ in range(150)]


def test_chunks_splice_to_the_whole_count(tokenizer):
    encode = C.encode_with_starts(tokenizer)
    for t in [*texts(), "a" * 3000, " " * 3000, "\n" * 900 + "x" * 900, ""]:
        want = len(tokenizer.encode(t, add_special_tokens=False))
        for chunk, overlap in ((150, 70), (400, 100), (200, 199)):
            assert C.count_in_chunks(t, encode, chunk, overlap) == want


def test_units_add_up(spark, documents, tokenizer):
    rows = [(i, t, "en") for i, t in enumerate([*texts(), None, "", "a b" * 20_000])]
    out = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(documents(rows), PATH).collect()}
    for i, t, _ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False))
        assert out[i] == (len((t or "").encode()), n, n > 512)
    assert C.token_counts(documents(rows).limit(0), PATH).count() == 0


def test_query_equals_the_library(spark, tokenizer):
    d = "/root/testdata/sf0.01"
    out = {r.doc_id: r.n_tokens for r in op6_token_counts(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        assert out[r.doc_id] == len(tokenizer.encode(r.text or "", add_special_tokens=False))
