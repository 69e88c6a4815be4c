import hashlib
import random
import re

from nivalis.llm import decontaminate as D
from nivalis.llm.queries import op10_decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    lengths = sorted({len(x) for x in windows})
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def collected(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_equals_brute_force_in_one_block_and_in_many(spark, documents):
    rng = random.Random(3)
    vocabulary = ["a", "B", "c", "É", "dd", "9"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randrange(0, 12))) for i in range(10)] + [(77, None), (3, "a B"), (12, "É")]
    docs = [(i, say(rng.randrange(0, 80))) for i in range(60)] + [(900, None), (901, ""), (902, "zz, a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = documents([(d, t, "en") for d, t in docs])
    want = brute(docs, items, 4)
    assert collected(D.report(D.matches(table, bench, window=4))) == want
    assert collected(D.report(D.matches(table, bench, window=4, block_bytes=60))) == want


def test_empty_tables(spark, documents):
    table = documents([(1, "a b c", "en"), (1, "a b c", "en")])
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [r.n_hit for r in D.report(D.matches(table, bench)).collect()] == [3, 3]
    assert [r.n_hit for r in D.report(D.matches(table, bench.limit(0))).collect()] == [0, 0]
    assert D.report(D.matches(table.limit(0), bench)).count() == 0


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    assert collected(op10_decontaminate(spark, d)) == brute(docs, items, 10)


def test_many_blocks_keep_repeated_and_null_ids_apart(spark, documents):
    rows = [(1, "a b c"), (1, "x y z"), (1, "a b c"), (None, "d e f"), (None, "a b c"), (None, "q q q")]
    bench = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "g h i")], "item_id long, text string")
    for block_bytes in (32_000_000, 20):
        found = D.matches(documents([(d, t, "en") for d, t in rows]), bench, block_bytes=block_bytes).collect()
        got = sorted((r.doc_id or 0, r.n_words, list(r["items"])) for r in found)
        assert got == [(0, 3, []), (0, 3, ["1"]), (0, 3, ["2"]), (1, 3, []), (1, 3, ["1"]), (1, 3, ["1"])]


def brute_matches(doc, items, window):
    """Longest runs on each diagonal, word by word."""
    w, out = words(doc), set()
    for i, t in items:
        v = words(t)
        least = min(window, len(v))
        for diagonal in range(-len(v), len(w)) if least else ():
            run = 0
            for q in range(len(v) + 1):
                p = q + diagonal
                if q < len(v) and 0 <= p < len(w) and w[p] == v[q]:
                    run += 1
                else:
                    if run >= least:
                        out.add((str(i), q - run, p - run, run))
                    run = 0
    return out


def test_longest_matches_and_places_equal_brute_force(spark, documents):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, say(rng.randrange(1, 14))) for i in range(6)] + [(50, "a a a a a a")]
    docs = [(i, say(rng.randrange(0, 50))) for i in range(25)] + [(80, "a " * 30), (81, f"{items[0][1]} x {items[1][1]} {items[2][1]}")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (32_000_000, 40):
        for r in D.matches(documents([(d, t, "en") for d, t in docs]), bench, window=4, block_bytes=block_bytes).collect():
            got = [(m["item"], m["item_begin"], m["begin"], m["n_words"]) for m in r["matches"]]
            assert len(got) == len(set(got)) and set(got) == brute_matches(dict(docs)[r.doc_id], items, 4)


def test_many_blocks_are_sent_one_after_the_other(spark, documents, monkeypatch):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(i, say(rng.randrange(1, 60))) for i in range(300)] * 2
    docs = [(i, say(20) + " " + " ".join(items[rng.randrange(300)][1] for _ in range(2))) for i in range(80)]
    live, most = set(), []
    send, kind = spark.sparkContext.broadcast, D.Broadcast

    def counted(value):
        live.add(sent := send(value))
        most.append(len(live))
        return sent

    destroy = kind.destroy
    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    monkeypatch.setattr(kind, "destroy", lambda self, *a: live.discard(self) or destroy(self, *a))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = collected(D.report(D.matches(documents([(d, t, "en") for d, t in docs]), bench, block_bytes=8_000)))
    assert got == brute(docs, items, 10)
    assert len(most) >= 5 and max(most) == 1 and not live
