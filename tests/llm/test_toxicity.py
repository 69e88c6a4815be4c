import math
import random
import re
from collections import Counter

import numpy as np

from nivalis.llm import toxicity as T
from nivalis.llm.queries import op2_toxicity


def brute_segments(scores):
    """Maximal segments by their definition: the best segment, then the same left and right of it."""
    best = (0, 0, 0)
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if (s, a - b) > (best[0], best[1] - best[2]) and s > 0:
                best = (s, a, b)
    if not best[0]:
        return []
    s, a, b = best
    return brute_segments(scores[:a]) + [(a, b, s)] + [(x + b, y + b, z) for x, y, z in brute_segments(scores[b:])]


def test_segments_equal_their_definition():
    rng = random.Random(8)
    for _ in range(200):
        scores = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 100 for _ in range(rng.randrange(14))]
        got = [(a, b, round(s, 6)) for a, b, s in T.maximal_segments(np.array(scores, dtype=float))]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def test_small_and_degenerate_tables(spark, documents):
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(40)]
    say = lambda bad: " ".join(rng.choice(["vileone", "viletwo", "scumbag"] if bad and k % 9 < 3 else plain) for k in range(30))
    rows = [(i, say(i % 4 == 0), "en") for i in range(400)] + [(900, None, None), (901, "", None), (902, "vilethree viletwo " + say(False), None)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(400)] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in T.held_out_scores(documents(rows), labels).collect()}
    assert len(out) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    wrong = [r for i, r in out.items() if i < 400 and r.held_out and r.predicted != int(i % 4 == 0)]
    assert len(wrong) <= 2 and not out[900].predicted and not out[901].predicted and out[902].predicted
    model = T.fit(documents(rows), labels)
    found = T.passages(" ".join(plain[:20] + ["vileone", "scumbag", "viletwo"] + plain[20:]), model)
    assert [(a, b) for a, b, _ in found] == [(20, 23)]
    assert {r.score for r in T.held_out_scores(documents(rows), labels.filter("toxic = 0")).collect()} == {0.0}
    assert T.held_out_scores(documents(rows).limit(0), labels.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in op2_toxicity(spark, d).collect() if r.held_out and r.doc_id in truth]
    hit = sum(p and t for p, t in held)
    assert hit / sum(t for _, t in held) > 0.75 and hit / max(1, sum(p for p, _ in held)) > 0.75


def test_every_feature_with_enough_documents_is_kept(spark, documents):
    text = " ".join(f"w{i}" for i in range(210_000))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    model = T.fit(documents([(i, text, "en") for i in range(12)]), labels)
    assert len(model.odds.scores) >= 210_000


def test_calibration_sums_all_segments_of_a_document(spark):
    words = T.split_words(["bad ok"], T.ALNUM_SEPARATORS, T.LOWER_AZ)
    odds = T.LogOdds(T.HashTable(words.hashes.copy()), np.where(words.hashes == words.hashes[0], 5.0, -9.0), -9.0)
    rows = [("bad ok " * (80 + 40 * k), k % 3 > 0) for k in range(9)] + [("ok " * (5 + k), False) for k in range(24)]
    rows += [("bad ok " * k, True) for k in range(1, 6)]
    made = T.calibrate(spark.createDataFrame(rows, "text string, toxic boolean"), odds)
    seen = [T._summary(n, np.asarray(s), made.lam, made.log_k) for n, s in T._segment_sums([t for t, _ in rows], odds)]
    x, y = np.column_stack((np.ones(len(seen)), np.array(seen))), np.array([t for _, t in rows], dtype=float)
    slope = x.T @ (y - 1 / (1 + np.exp(-np.clip(x @ made.weights, -30, 30)))) - 1e-2 * made.weights
    assert max(x[:, 2]) > np.log(64) and np.abs(slope).max() < 1e-5


def brute_features(text):
    """Per word its features from short prefix to whole word, as (level, bytes)."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    return [[(n, w[:n]) for n in T.PREFIXES if len(w) > n] + [(255, w)] for w in words]


def brute_model(rows, strength=3.0, margin=3.0, min_docs=3):
    """Log-odds of all features, by dictionaries. rows: (text, toxic)."""
    base = sum(t for _, t in rows) / len(rows)
    seen, parent = {True: Counter(), False: Counter()}, {}
    for text, toxic in rows:
        own = set()
        for chain in brute_features(text):
            parent.update({f: chain[:k][::-1] for k, f in enumerate(chain)})
            own.update(chain)
        seen[toxic].update(own)
    rate = {}
    for f in sorted(parent, key=lambda f: f[0]):
        bad, n = seen[True][f], seen[True][f] + seen[False][f]
        if n >= min_docs:
            prior = rate[parent[f][0]] if parent[f] else base
            rate[f] = (bad + strength * prior) / (n + strength)
    clipped = {f: min(max(r, 1e-6), 1 - 1e-6) for f, r in rate.items()}
    return {f: min(max(math.log(r / (1 - r)) - math.log(base / (1 - base)), -2), 6) - margin for f, r in clipped.items()}


def test_scores_equal_brute_force(spark, documents):
    """Every document's score again, from features, segments and the fitted law, word by word."""
    rng = random.Random(3)
    plain = [f"{a}{b}{c}" for a in ("sun", "gar", "Wölk") for b in ("light", "den", "path") for c in ("", "s", "ing")]
    say = lambda bad: " ".join(rng.choice(["vileness", "vilely", "scumbags"] if bad and k % 8 < 3 else plain) for k in range(rng.randrange(5, 40)))
    rows = [(i, say(i % 4 == 0)) for i in range(300)] + [(900, None), (901, "vilest Wölkpath, unseen"), (5, say(True))]
    table = documents([(i, t, "en") for i, t in rows])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    known = table.join(labels.withColumn("toxic", labels.toxic > 0), "doc_id").select("text", "toxic")
    odds = T.fit_log_odds(known, 3.0, 3.0, 3)
    want = brute_model([(r.text, r.toxic) for r in known.collect()])
    assert len(odds.scores) == len(want)
    model = T.Model(odds, T.calibrate(known, odds))
    cal = model.calibration
    got = sorted((r.doc_id, round(r.score, 6), r.n_passages) for r in T.score(table, model).collect())
    expect = []
    for i, text in rows:
        scores = [next((want[f] for f in reversed(chain) if f in want), -3.0) for chain in brute_features(text)]
        x = [cal.lam * s - cal.log_k - math.log(len(scores)) for _, _, s in brute_segments([float(v) for v in scores])]
        seen = (1.0, min(max(*x, -10), 60) if len(x) > 1 else min(max(x[0], -10), 60), math.log1p(sum(v for v in x if v > 0))) if x else (1.0, -10.0, 0.0)
        z = sum(a * b for a, b in zip(cal.weights, seen, strict=True))
        expect.append((i, round(1 / (1 + math.exp(-min(max(z, -30), 30))), 6), sum(v > 0 for v in x)))
    assert got == sorted(expect)
