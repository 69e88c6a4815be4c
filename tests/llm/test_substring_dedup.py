import hashlib
import random
import re

import numpy as np

from nivalis.llm import substring_dedup as S
from nivalis.llm.queries import op4_substring_dedup


def brute(rows, window):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, d), d)
    out = set()
    for d, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.add((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def collected(df):
    return {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_equals_brute_force(documents):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["é", "b", "cc", "d", "e,"]) for _ in range(n))
    shared = [say(30) for _ in range(5)]
    rows = []
    for i in range(80):
        parts = [say(rng.randrange(0, 15)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared).split()
            a = rng.randrange(0, 10)
            parts.insert(rng.randrange(3), " ".join(s[a : a + rng.randrange(8, 25)]))
        rows.append((i * 3 % 241, "\n ".join(parts)))
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, shared[0]), (1003, None), (1004, ""), (1005, " \t"), (1006, "one")]
    found = S.strip_repeats(documents([(d, t, "en") for d, t in rows]), window=10, phrase=3)
    assert collected(found) == brute(rows, 10)
    for r in found.collect():  # spans, kept words and counts say the same
        w = re.findall(r"[^\x20\x09-\x0D]+", dict(rows)[r.doc_id] or "")
        gone = {k for a, b in zip(r.begins, r.ends, strict=True) for k in range(a, b)}
        assert len(gone) == r.n_removed and (r.kept is None) == (not gone)
        assert r.kept is None or r.kept == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_null_ids_repeated_rows_and_empty_tables(documents):
    text = " ".join(f"w{i}" for i in range(20))
    table = documents([(None, text, "en"), (5, text, "en"), (5, text, "en"), (9, "x " + text, "en")])
    got = sorted((str(r.doc_id), r.n_removed) for r in S.strip_repeats(table, window=10, phrase=3).collect())
    assert got == [("5", 0), ("5", 0), ("9", 20), ("None", 0)]
    assert S.strip_repeats(table.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(op4_substring_dedup(spark, d)) == brute(rows, 50)


def test_windows_of_one_hash_are_told_apart_by_their_check():
    hashes, checks, least = np.array([7, 7, 9, -4, 7]), np.array([1, 2, 1, -3, -1], np.int32), np.array([10, 20, 30, 40, 50])
    sources, none = S.Sources(hashes, checks, least), np.iinfo(np.int64).max
    assert sources.find(np.array([7, 7, 7, 7, 9, 9, -4, 8]), np.array([2, 1, -1, 3, 1, 2, -3, 1], np.int32)).tolist() == [20, 10, 50, none, 30, none, 40, none]
    empty = np.zeros(0, np.int64)
    assert S.Sources(empty, empty.astype(np.int32), empty).find(hashes, checks).tolist() == [none] * 5
