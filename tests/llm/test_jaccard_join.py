import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from nivalis.llm import jaccard_join as J
from nivalis.llm.queries import op3_jaccard_join
from nivalis.llm.tables import settle


def shingles(text, n=5):
    w = (text or "").split()
    if not w:
        return frozenset()
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(rows, threshold=0.8):
    """(class, links) per id, by comparing every two documents that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    pairs = {p for own in holders.values() for p in combinations(sorted(own), 2)}
    links, parent = dict.fromkeys(sets, 0), {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if common * (1 + threshold) >= threshold * (len(sets[a]) + len(sets[b])) - 1e-9:
            links[a] += 1
            links[b] += 1
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    return {d: (root(d), links[d]) for d in sets}


def collected(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        out.append(" ".join(w))
    return out


def test_links_and_classes_equal_brute_force(documents):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    texts = family(rng, base, 60, 4) + [f"{' '.join(rng.sample(base, 40))}" for _ in range(20)]
    texts += ["a b c", "a b c", "a  b\nc", "", None, " ", "one", "one two three four five six"] + texts[:7]
    rows = list(enumerate(texts))
    table = documents([(i, t, "en") for i, t in rows])
    want = brute(rows)
    for block in (1024, 8):  # in one block, and dealt over many block pairs
        assert collected(J.near_duplicates(table, block=block)) == want


def test_loose_groups_are_verified_band_by_band(documents, monkeypatch):
    rng = random.Random(4)
    chain, texts = [f"w{i}" for i in range(100)], []
    for _ in range(60):  # each text shares much with the next, the first nothing with the last
        chain = chain[3:] + [f"n{rng.random()}" for _ in range(3)]
        texts.append(" ".join(chain))
    rows = list(enumerate(texts + texts[::7]))
    seen = []
    units = J._units
    monkeypatch.setattr(J, "_units", lambda *a: seen.append(units(*a)) or seen[-1])
    got = collected(J.near_duplicates(documents([(i, t, "en") for i, t in rows]), block=4))
    assert got == brute(rows)
    assert seen and max(c for c, _ in got.values()) < 60


def test_units_of_a_loose_group_are_its_bands(spark):
    groups = spark.createDataFrame([(k, 0) for k in range(40)], "node long, component long")
    shared = spark.createDataFrame([(k + j, 0, k, 2) for k in range(39) for j in (0, 1)], "node long, band int, key long, n long")
    assert {r.band for r in J._units(groups, shared, 4).collect()} == {0}  # 78 copies of sets against 400
    dense = spark.createDataFrame([(k, b, b, 40) for k in range(40) for b in range(18)], "node long, band int, key long, n long")
    assert {r.band for r in J._units(groups, dense, 4).collect()} == {-1}


def test_an_id_with_two_texts_keeps_the_links_of_both(documents):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    table = documents([(1, a, "en"), (1, b, "en"), (2, a + " more", "en"), (3, b + " more", "en")])
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in J.near_duplicates(table).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_null_ids_repeated_rows_and_empty_tables(documents):
    text = " ".join(f"w{i}" for i in range(30))
    table = documents([(None, text, "en"), (5, text, "en"), (5, text, "en"), (None, "z", None), (9, text + " more", "en")])
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in J.near_duplicates(table).collect())
    assert got == [("5", "5", 3), ("5", "5", 3), ("9", "5", 3), ("None", "5", 3), ("None", "None", 0)]
    assert J.near_duplicates(table.limit(0)).count() == 0


def test_rows_without_an_id_are_linked_to_near_texts(documents):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = family(rng, base, 30, 4) + family(rng, [f"v{i}" for i in range(90)], 6, 1)
    ids = [None if i % 3 == 0 or i >= 30 else i for i in range(36)]  # the second family has no id at all
    want = brute(list(enumerate(texts)))
    for block in (1024, 8):
        got = J.near_duplicates(documents([(i, t, "en") for i, t in zip(ids, texts, strict=True)]), block=block).collect()
        named = {c: min((ids[j] for j in range(36) if want[j][0] == c and ids[j] is not None), default=None) for c, _ in want.values()}
        expected = [(ids[k], named[want[k][0]], want[k][1]) for k in range(36)]
        assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == sorted((str(a), str(b), c) for a, b, c in expected)


def test_a_document_repeated_very_often_sends_its_set_once(spark, monkeypatch):
    text, seen = " ".join(f"w{i}" for i in range(60)), []
    sets = J._sets
    monkeypatch.setattr(J, "_sets", lambda *a: seen.append(settle(sets(*a), "sets")) or seen[-1])
    table = spark.range(100_000).select(F.when(F.col("id") > 10, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(text).alias("text"))
    table = table.unionByName(spark.createDataFrame([(100, text + " more")], table.schema))
    got = J.near_duplicates(table).groupBy("class_id").agg(F.count("*").alias("rows"), F.min("n_links").alias("links")).collect()
    assert [tuple(r) for r in got] == [(0, 100_001, 100_000)]
    assert seen[0].count() == 2


def test_bands_reach_the_recall():
    for recall in (0.9, 0.999, 0.9999):
        bands, rows = J.choose_bands(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 96


def test_minhash_agrees_as_often_as_the_sets_do():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)))
    m = J.MinHash(2000, 1)
    assert abs((m.keys(a) == m.keys(b)).mean() - 0.8) < 0.04


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(op3_jaccard_join(spark, d)) == brute(rows)
