import random
import re

import numpy as np

from nivalis.llm import words as W


def test_words_equal_the_regular_expressions():
    rng = random.Random(1)
    texts = [None, "", " ", "a", " x y\x1cz", *("".join(rng.choices("aA1 \t\né　-_|", k=rng.randrange(60))) for _ in range(80))]
    plain = W.split_words(texts)
    lower = W.split_words(texts, W.ALNUM_SEPARATORS, W.LOWER_AZ)
    for k, t in enumerate(texts):
        assert [plain.text(i).decode() for i in range(*plain.doc(k).indices(10**9))] == re.findall(r"[^\x20\x09-\x0D]+", t or "")
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        assert [lower.text(i).decode() for i in range(*lower.doc(k).indices(10**9))] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def test_hashes_follow_the_words_not_their_place(monkeypatch):
    monkeypatch.setattr(W, "PIECE_BYTES", 7)
    a = W.split_words(["one two three", "two", "three one", "averyveryverylongword one"])
    seen = {}
    for i, h in enumerate(a.hashes):
        assert seen.setdefault(a.text(i), h) == h
    assert len(set(seen.values())) == len(seen)
    w = W.window_hashes(a.hashes, 2)
    assert len(w) == len(a.hashes) - 1 and len(W.window_hashes(a.hashes, 99)) == 0


def test_hash_table_finds_positions():
    keys = np.array([9, 4, 7], dtype=np.uint64)
    assert W.HashTable(keys).find(np.array([7, 8, 9, 4], dtype=np.uint64)).tolist() == [2, -1, 0, 1]
    assert W.HashTable(keys[:0]).find(keys).tolist() == [-1, -1, -1]
