import math
import random
import re
from collections import Counter

import numpy as np

from nivalis.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, id string, score string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, k=20):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t, _ in rows]
    held = [x for x in held if x[2]]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    words = ["ab", "AB", "ßtraße", "Éa", "x1", "don't", "a-b", "the", "The", "日本", "q" * 40, "zz", "y"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))), "en") for i in range(60)]
    rows += [(100 + i, "the same text AB, x1", "en") for i in range(45)]  # one class, more than are ranked
    rows += [(7, "the same text AB, x1", "en"), (7, "the same text AB, x1", "en"), (None, "the same text ab x1", "en"), (2**53 + 1, "zz ab", "en")]
    rows += [(200, None, "en"), (201, "", "en"), (202, "-- !?", "en"), (203, "ab the " * 20_000, "en")]
    items = [(1, "The same AB ab"), (2, "zz zz ßTRAßE"), (3, None), (4, ""), (5, "unheard"), (2, "x1 日本 éA Éa"), (None, "don't y"), (8, "q" * 40)]
    return rows, items


def collected(out):
    return sorted([tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()], key=str)


def test_equals_brute_force_in_one_block_and_in_many(spark, documents):
    rows, items = cases()
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS)
    want = brute(rows, items)
    for block_bytes in (2_000_000, 20):
        assert collected(R.search(documents(rows).repartition(3), asked, block_bytes=block_bytes)) == want
    assert collected(R.search(documents(rows), asked, k=3)) == brute(rows, items, 3)


def test_empty_tables(spark, documents):
    rows, items = cases()
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS)
    assert R.search(documents(rows).limit(0), asked).count() == 0
    assert R.search(documents(rows), asked.limit(0)).count() == 0


def test_small_batches_give_the_same_best():
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 9, (400, 5))
    first = rng.permutation(400)
    best = R.Best(5, 4)
    for lo in range(0, 400, 7):
        best.add(scores[lo : lo + 7], np.zeros(len(first[lo : lo + 7]), np.int64), first[lo : lo + 7], np.arange(400)[lo : lo + 7])
        if lo % 3 == 0:
            best.settle()
    item, score, _, _, number = best.settle()
    for i in range(5):
        want = sorted(range(400), key=lambda c: (-scores[c, i], first[c]))[:4]
        assert number[item == i].tolist() == want


def test_words_of_an_equal_hash_are_told_apart():
    queries = R.Queries.of([(0, "abc abd")])
    words = R.split_words(["abd abc abx"], R.ALNUM_SEPARATORS, R.LOWER_AZ)
    words.hashes[2] = words.hashes[0]
    assert queries.find(words).tolist()[2] == -1
    assert sorted(queries.find(words).tolist()[:2]) == [0, 1]
