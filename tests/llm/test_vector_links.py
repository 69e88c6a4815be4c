import numpy as np

from nivalis.llm import vector_links as V
from nivalis.llm.queries import op12_vector_links

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, node string, list string"


def brute(rows, threshold=0.9):
    usable = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(rows)
    for size in {len(rows[k][1]) for k in usable}:
        own = [k for k in usable if len(rows[k][1]) == size]
        x = np.array([rows[k][1] for k in own], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if a != b:
                links[own[a]] += 1
                root[find(own[a])] = find(own[b])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(find(k)) if k in usable else i
        out.append((i, links[k], c, i is not None and i == c))
    return sorted(out, key=str)


def near(rng, v, cosine):
    aside = rng.standard_normal(len(v))
    aside -= aside @ v * v
    return cosine * v + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)


def unit(rng, n):
    v = rng.standard_normal(n)
    return v / np.linalg.norm(v)


def result(df, **more):
    return sorted([tuple(r) for r in V.near_vectors(df, **more).collect()], key=str)


def table(spark, rows):
    full = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y", "z") for i, v in rows]
    return spark.createDataFrame(full, SCHEMA)


def test_equals_brute_force_in_all_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, unit(rng, 10)) for i in range(300)]
    chain = unit(rng, 10)
    for i in range(40):
        rows.append((1000 - i, chain))
        chain = near(rng, chain, 0.93)
    hot = unit(rng, 10)
    rows += [(2000 + i, near(rng, hot, 0.99)) for i in range(200)]  # one list, several blocks
    rows += [(3000 + i, 7 * hot) for i in range(30)]  # equal rows
    rows += [(5, hot), (5, hot), (None, hot), (None, unit(rng, 10)), (2**53 + 1, near(rng, rows[3][1], 0.97))]
    bad = [None, [], [0.0] * 10, [1.0, None] * 5, [float("nan")] * 10, [float("inf")] + [0.0] * 9]
    rows += [(4000 + k, v) for k, v in enumerate(bad)]
    rows += [(5000, rows[0][1][:7]), (5001, rows[0][1][:7]), (5002, [*rows[0][1], 0.0])]
    assert result(table(spark, rows), block=64) == brute(rows)
    assert result(table(spark, rows).limit(0)) == []
    assert result(table(spark, [(4, None), (None, [0.0])])) == sorted([(4, 0, 4, True), (None, 0, None, False)], key=str)


def test_pairs_just_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        v = unit(rng, 64)
        rows += [(2 * i, v), (2 * i + 1, near(rng, v, 0.903))]
    want, got = brute(rows), result(table(spark, rows))
    linked = sum(x[1] for x in want)
    assert linked >= 6000
    assert sum(x[1] for x in got) >= 0.995 * linked
    assert not [x for x, y in zip(got, want, strict=True) if x[1] > y[1]]


def test_codes_lose_no_member_of_a_visited_list():
    rng = np.random.default_rng(2)
    x = np.stack([unit(rng, 16) for _ in range(400)])
    x = np.concatenate((x, np.stack([near(rng, v, 0.91) for v in x])))
    q = V.fit(x.astype(np.float32), 8, 0.9, 0.99)
    codes, left = q.code(x.astype(np.float32), np.zeros(len(x), dtype=int))
    side = {"vector": x, "node": np.arange(len(x)), "size": np.full(len(x), 16), "code": codes, "left": left}
    i, j = V.links_of_unit(q, 0, 0.9, side, side)
    a, b = np.nonzero((x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(a.tolist(), b.tolist(), strict=True))


def test_query_recall_against_brute_force(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = brute(rows)
    got = sorted([tuple(r) for r in op12_vector_links(spark, d).collect()], key=str)
    assert sum(x[1] for x in got) >= 0.99 * sum(x[1] for x in want)
