import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from nivalis.llm import token_alignment as T
from nivalis.llm.queries import op13_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(text, p):
    """Groups and linked pairs of one text, byte by byte."""
    if not text:
        return None
    whole = (" " + text).encode()
    out = []
    for ids, spelled in ((p.a.encode(" " + text, add_special_tokens=False).ids, p.spelled_a), (p.b.encode(text), p.spelled_b)):
        if min(spelled.sizes[ids]) < 0 or spelled.spell(np.array(ids)).tobytes() != whole:
            return None
        ends = np.cumsum(spelled.sizes[ids]).tolist()
        out.append((ids, ends))
    (ids_a, ends_a), (ids_b, ends_b) = out
    links = []
    j = 0
    for k, end in enumerate(ends_a):
        begin = ends_a[k - 1] if k else 0
        while ends_b[j] <= begin:
            j += 1
        m = j
        while m < len(ids_b) and (ends_b[m - 1] if m else 0) < end:
            links.append((ids_a[k], ids_b[m]))
            m += 1
    groups, i, k = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        j, m = ends_a.index(end, i) + 1, ends_b.index(end, k) + 1
        groups.append(",".join(map(str, ids_a[i:j])) + "|" + ",".join(map(str, ids_b[k:m])))
        i, k = j, m
    return len(ids_a), len(ids_b), groups, links


def brute(rows, p):
    found = [(i, aligned(t, p)) for i, t in rows]
    count = Counter()
    for _, f in found:
        count.update(set(f[3]) if f else ())
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(count[x] == most[x[0]] for x in f[3])
            out.append((i, f[0], f[1], len(f[2]), len(f[3]), best, sum(count[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))
    return sorted(out, key=str)


def collected(out):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted([tuple(r) for r in out.select(*names).collect()], key=str)


@pytest.fixture(scope="module")
def pair():
    return T._pair(A, B)


def texts():
    rng = random.Random(8)
    bits = ["the ", " the", "  ", "\n\n", " ", "\t", "don't", "ré", "<|endoftext|>", "</s>", "1234", "aaaa", "%%", "　", "日本", " x", "naïve ", "(foo) ", "😀", "\x00", "word. ", "ßß", "'"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 200))) for _ in range(80)]
    return [*out, "a▁b", "▁", " ", "  x", "\n", "x" * 3000, "word " * 2000, " " * 700 + "é" * 700, "in ▁ " + "long text " * 300]


def test_equals_brute_force_for_short_and_long_documents(spark, documents, pair):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(500, None), (501, ""), (502, rows[3][1]), (502, rows[3][1]), (None, rows[4][1]), (2**53 + 1, rows[5][1])]
    docs = documents([(i, t, "en") for i, t in rows]).repartition(3)
    want = brute(rows, pair)
    assert sum(x[1] == 0 for x in want) == 5
    assert collected(T.alignments(docs, A, B)) == want
    assert collected(T.alignments(docs, A, B, chunk=90, fan=3)) == want
    assert collected(T.alignments(docs, A, B, chunk=700, fan=2, kept_pairs=0)) == want
    assert T.alignments(docs.limit(0), A, B).count() == 0


def test_composing_is_associative_and_loses_nothing(pair):
    rng = random.Random(2)
    for text in texts():
        f = aligned(text, pair)
        if f is None:
            continue
        id_a, id_b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
        whole = T.Tokens(np.cumsum(pair.spelled_a.sizes[id_a]), np.array(id_a), np.cumsum(pair.spelled_b.sizes[id_b]), np.array(id_b))
        cuts = sorted(rng.sample(range(len(text.encode()) + 1), min(9, len(text.encode()))))
        parts = []
        groups = []
        # the two streams are cut at different bytes
        a = [0, *np.searchsorted(whole.end_a, cuts).tolist(), len(whole.end_a)]
        b = [0, *np.searchsorted(whole.end_b, [c + rng.randrange(3) for c in cuts]).tolist(), len(whole.end_b)]
        b = np.maximum.accumulate(b).tolist()
        for i, j, k, m in zip(a[:-1], a[1:], b[:-1], b[1:], strict=True):
            part, closed = T.fragment(T.Tokens(whole.end_a[i:j], whole.id_a[i:j], whole.end_b[k:m], whole.id_b[k:m]))
            parts.append(part)
            groups.append(closed)
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            joined, closed = T.compose(parts[k], parts[k + 1])
            parts[k : k + 2] = [joined]
            groups.append(closed)
        assert not len(parts[0].suffix)
        groups.append(parts[0].prefix)
        said = [T.described(g, pair.width) for g in sorted((g for g in groups if len(g)), key=lambda g: g.end_a[-1])]
        assert [t for s in said for t in s[0]] == f[2]
        assert sorted(x for s in said for x in s[3].tolist()) == sorted(x * pair.width + y for x, y in f[3])


def test_parts_cover_the_text(pair):
    for text in texts():
        parts = list(T.parts_of(" " + text, 64))
        assert "".join(p[1] for p in parts) == "".join(p[3] for p in parts) == " " + text
        assert [p[2] for p in parts] == np.cumsum([0, *(len(p[1].encode()) for p in parts[:-1])]).tolist()


def test_query_equals_brute_force(spark, pair):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(op13_token_alignment(spark, d)) == brute(rows, pair)
