import math
from collections import Counter
from zlib import crc32

import numpy as np

from nivalis.llm import gru, language_model as L
from nivalis.llm.queries import op7_language_model


def tokens(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in " ".join((text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")).split(" ") if w] + [None]


def brute(rows):
    train = Counter()
    for d, t in rows:
        if crc32(str(d).encode()) % 7 != 2:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    out = {}
    for d, t in rows:
        own = tokens(t)
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in own)
        out[d] = (crc32(str(d).encode()) % 7 == 2, len(own), sum(train[w] > 0 for w in own), n, round(base, 6))
    return out


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    net = gru.Net.create(rng.integers(1, 9, 12).astype(float), 5, 4)
    net = net.filled(rng.standard_normal(len(net.flat())) * 0.4)
    docs = [np.append(rng.integers(1, 12, n), 0) for n in (3, 6, 2, 4)]
    p = gru.pack(docs, 2)
    args = (p.inputs, p.targets, p.fresh, p.doc >= 0, np.zeros((2, 5), np.float32))
    grads = np.concatenate([g.ravel() for g in gru.gradients(net, *args)[2]])
    flat = net.flat()
    for k in rng.choice(len(flat), 60, replace=False):
        move = np.zeros_like(flat)
        move[k] = 3e-2
        up, down = (gru.gradients(net.filled(flat + s * move), *args) for s in (1, -1))
        assert abs((up[0] - down[0]) / up[1] / 6e-2 - grads[k]) < 5e-3


def test_probabilities_sum_to_one_and_windows_do_not_matter():
    rng = np.random.default_rng(3)
    net = gru.Net.create(np.arange(1.0, 11), 6, 4)
    net = net.filled(np.where(net.flat() < -100, net.flat(), rng.standard_normal(len(net.flat()))))
    total = sum(np.exp(gru.log_probabilities(net, np.append(np.full(6, 0.3, np.float32), np.float32(1))[None], np.array([w]))[0]) for w in range(10))
    assert abs(total - 1) < 1e-4
    docs = [np.append(rng.integers(1, 10, n), 0) for n in (40, 3, 0, 17, 9)]
    whole = gru.score(net, docs, lanes=2, window=1000)
    assert np.allclose(whole, gru.score(net, docs, lanes=2, window=5), atol=1e-3)
    assert np.allclose(whole, [gru.score(net, [d])[0] for d in docs], atol=1e-3)


def test_counts_and_base_equal_brute_force(documents):
    rows = [(i, ("The cat %d sat É\n" % (i % 7)) * (i % 5)) for i in range(60)] + [(97, None), (98, ""), (99, "never seen Words")]
    for listed in (1 << 18, 3):  # all words listed, or most joined
        out = L.held_out_scores(documents([(d, t, "en") for d, t in rows]), listed=listed, vocabulary=6, width=2)
        got = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.collect()}
        assert got == brute(rows)
    assert L.held_out_scores(documents(rows_ := []), listed=3).count() == len(rows_)


def test_query_counts_and_gain(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    out = op7_language_model(spark, d).collect()
    want = brute(rows)
    for r in out:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert abs(r.base_score - want[r.doc_id][4]) < 1e-4
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)


def test_every_training_document_teaches_once(documents, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "train_round", lambda docs, known, net, *rest: seen.append([r.doc_id for r in docs.collect()]) or net)
    for shard_tokens in (10, 50, 1000):
        seen.clear()
        L.fit(documents([(i, "a b", "en") for i in range(200)]), vocabulary=6, width=2, shard_tokens=shard_tokens)
        assert len(seen) == L.plan_rounds(600, shard_tokens)[0] and sorted(sum(seen, [])) == list(range(200))


def test_scores_do_not_depend_on_how_rows_are_split(documents):
    rows = [(i, f"the cat sat on mat {i % 7} and {i % 3}", "en") for i in range(300)]
    one, many = (
        {r.doc_id: r.score for r in L.held_out_scores(documents(rows).repartition(n), vocabulary=16, width=4, shard_tokens=500).collect()} for n in (1, 7)
    )
    assert all(abs(one[k] - many[k]) < 1e-3 for k in one)


def brute_score(net, known, number, train, words):
    """Word by word: the network's share of the word, and an unknown word's share of the counts."""
    n, width = len(net.gates), net.to_word.shape[2]
    h, last, total = np.zeros(n), 0, 0.0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for w in words:
        x = np.concatenate((net.table[last], net.table_new[last])).astype(float)
        z, r = sigmoid(x[:n] + h @ net.gates[:, :n]), sigmoid(x[n : 2 * n] + h @ net.gates[:, n:])
        h = h + z * (np.tanh(x[2 * n :] + (r * h) @ net.gates_new) - h)
        s, last = np.append(h, 1), 0 if w is None else number.get(w, 1)
        classes, inside = s @ net.to_class, s @ net.to_word[last // width]
        total += classes[last // width] - np.log(np.exp(classes).sum()) + inside[last % width] - np.log(np.exp(inside).sum())
        if last == 1:
            total += np.log((train[w] + 1) / known.outside)
    return total / np.log(10)


def test_score_equals_brute_force(documents):
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 13))) for i in range(80)] + [(200, None), (201, "w1 unseen W2 unseen")]
    counts, known, net = L.fit(documents([(d, t, "en") for d, t in rows[:80]]), vocabulary=8, width=3, shard_tokens=200, listed=6)
    train = Counter(w for _, t in rows[:80] for w in tokens(t))
    names = sorted((w for w in train if w), key=lambda w: (-train[w], int(L.split_words([w]).hashes.view(np.int64)[0])))
    number = {w: k + 2 for k, w in enumerate(names[:6])}
    assert len(number) == len(known.vocabulary) or len(known.vocabulary) < 6  # fewer where ties do not fit the list
    number = {w: k for w, k in number.items() if k < len(known.vocabulary) + 2}
    got = {r.doc_id: r.score for r in L.score(documents([(d, t, "en") for d, t in rows]), counts, known, net).collect()}
    for d, t in rows:
        assert abs(got[d] - brute_score(net, known, number, train, tokens(t))) < 1e-3
