"""Document log-likelihoods under a gated recurrent language model, and a smoothed unigram base.

Tokens are words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, and one end per document.  Their counts
cover all training documents.  The `vocabulary` most frequent are words of the network; the rest
share its unknown word, whose probability is divided by count: P(w) = P(unknown | state) *
(c + 1) / (N' + V' + 1), N' and V' being the tokens and distinct words outside the network.

The network starts at the word frequencies.  The rounds share out all training documents, by hash of
id, so each teaches once; their number grows with the logarithm of the corpus.  A round's documents
are dealt, by hash again, into shards of about `shard_tokens` tokens.  Each shard trains a copy by
truncated back-propagation, and the copies are averaged, weighted by tokens, in two levels of grouped
averages; only one network's worth of numbers ever reaches the driver.  Rounds and shards follow from
ids and the count of tokens alone, so results do not depend on how files are split.

Counts of the most frequent words (at most `listed`) are sent to all tasks; the other words of the
documents are joined to the count table.

Defined cases: a null or empty text is one end token; rows with a null id are scored, never
learnt; repeated rows count repeatedly and give a row each; an empty table gives an empty table;
without training tokens every count is zero and the network knows the end alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivalis.llm import gru
from nivalis.llm.tables import carried, remainder, settle
from nivalis.llm.words import LOWER_AZ, SPACE_SEPARATORS, HashTable, by_bytes, split_words

#: Stands for the end token among word hashes.
_END = np.uint64(0x0E4D0E4D0E4D0E4D)
_CHUNK = 16_384
_HELD = 3_000_000


@dataclass(frozen=True)
class Counts:
    """What every task knows: totals, and the most frequent words in order of falling count."""

    tokens: int
    distinct: int
    words: HashTable
    counts: np.ndarray
    vocabulary: np.ndarray  # indices into words and counts, network words from number 2 on
    number: np.ndarray  # network number of each listed word
    outside: int  # N' + V' + 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): hashes and counts of the tokens of all rows (text), added up per task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, rows = [], [], 0

        def merged() -> pd.DataFrame:
            key, at = np.unique(np.concatenate([*keys, [_END]]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([*counts, [rows]])).astype(np.int64)
            return pd.DataFrame({"word": key.view(np.int64), "n": n})[n > 0]

        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in by_bytes(texts, 8_000_000):
                key, n = np.unique(split_words(texts[lo:hi], SPACE_SEPARATORS, LOWER_AZ).hashes, return_counts=True)
                keys.append(key)
                counts.append(n)
            rows += len(pdf)
            if sum(map(len, keys)) > _HELD:
                yield merged()
                keys, counts, rows = [], [], 0
        yield merged()

    return docs.select("text").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gather(counts: DataFrame, vocabulary: int, listed: int) -> Counts:
    bins = F.floor(F.log2("n") * 8)
    spread = counts.groupBy(bins.alias("bin")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).toPandas()
    spread = spread.sort_values("bin", ascending=False)
    tokens, distinct = int(spread["n"].sum()), int(spread["v"].sum())
    fits = spread["v"].cumsum() <= listed
    least = spread["bin"][fits].min() if fits.any() else np.inf
    end = F.col("word") == int(_END)
    top = counts.filter((bins >= float(least)) | end if fits.any() else end).toPandas()  # <= listed rows and the end
    top = top.sort_values(["n", "word"], ascending=[False, True])
    words, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    chosen = np.flatnonzero(words != _END)[: vocabulary - 2]
    number = np.full(len(words), gru.UNKNOWN)
    number[chosen] = np.arange(len(chosen)) + 2
    number[words == _END] = gru.END
    inside = int(n[chosen].sum() + n[words == _END].sum())
    outside = tokens - inside + distinct - len(chosen) - int((words == _END).any()) + 1
    return Counts(tokens, distinct, HashTable(words), n, chosen, number, outside)


def initial_net(known: Counts, hidden: int, width: int) -> gru.Net:
    ends = int(known.counts[known.number == gru.END].sum())
    shares = np.concatenate(([ends + 1, known.outside], known.counts[known.vocabulary] + 1.0))
    return gru.Net.create(shares, hidden, width)


def _documents(texts: list[str | None], known: Counts):
    """Per text the word numbers with the final end, and for all words their listed index."""
    words = split_words(texts, SPACE_SEPARATORS, LOWER_AZ)
    listed = known.words.find(words.hashes)
    number = np.where(listed >= 0, known.number[listed] if len(known.number) else 0, gru.UNKNOWN).astype(np.int32)
    docs = [np.append(number[words.doc(k)], np.int32(gru.END)) for k in range(len(texts))]
    return words, listed, docs


def _averaged(made: DataFrame, keys: list[str]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = pdf["weight"].to_numpy(float)
        total = sum(w * np.frombuffer(d, np.float32).astype(float) for w, d in zip(weight, pdf["data"], strict=True))
        data = (total / max(weight.sum(), 1)).astype(np.float32).tobytes()
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "weight": int(weight.sum()), "data": [data]})

    return made.groupBy(*keys).applyInPandas(run, "chunk int, weight long, data binary")


def _hashed(salt: str) -> Column:
    """A number in [0, 1) drawn from the id."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1 << 20)) / (1 << 20)


def train_round(docs: DataFrame, known: Counts, net: gru.Net, shards: int, rate: float, window: int, lanes: int, fan_in: int = 64) -> gru.Net:
    """One copy of the network per shard, trained on its documents; their average."""
    context = docs.sparkSession.sparkContext
    sent, start = context.broadcast(known), context.broadcast(net)

    def taught(shard: int, parts: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
        own = start.value.filled(start.value.flat())
        parts.sort(key=lambda part: part[0])
        _, tokens = gru.train(own, gru.Adam(own, rate), [d for _, d in parts], window, lanes, updates=60)
        flat = own.flat()
        cut = [flat[k : k + _CHUNK].tobytes() for k in range(0, len(flat), _CHUNK)]
        return pd.DataFrame({"some": shard // fan_in, "chunk": np.arange(len(cut), dtype=np.int32), "weight": tokens, "data": cut})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}  # word numbers of the shards of this task
        for pdf in batches:
            texts, shard, order = pdf["text"].tolist(), pdf["shard"].tolist(), pdf["order"].tolist()
            for lo, hi in by_bytes(texts, 8_000_000):
                for k, d in enumerate(_documents(texts[lo:hi], sent.value)[2], lo):
                    held.setdefault(shard[k], []).append((order[k], d))
        while held:
            yield taught(*held.popitem())

    rows = docs.select("text", F.floor(_hashed("shard") * shards).cast("int").alias("shard"), F.xxhash64("doc_id", "text").alias("order"))
    made = rows.repartitionById(shards, F.col("shard")).mapInPandas(run, "some int, chunk int, weight long, data binary")
    some = _averaged(made, ["chunk", "some"])
    found = sorted(_averaged(some, ["chunk"]).collect(), key=lambda r: r["chunk"])
    sent.destroy()
    return net.filled(np.concatenate([np.frombuffer(r["data"], np.float32) for r in found])) if found else net


def plan_rounds(tokens: int, shard_tokens: int) -> tuple[int, int]:
    """(rounds, shards a round): one round more for every doubling of the tokens."""
    rounds = 2 + max(0, round(np.log2(max(tokens, 1) / (4 * shard_tokens))))
    return rounds, max(1, round(tokens / (rounds * shard_tokens)))


def fit(
    docs: DataFrame,
    vocabulary: int = 4096,
    width: int = 64,
    hidden: int = 16,
    listed: int = 1 << 18,
    shard_tokens: int = 2_000_000,
    rate: float = 0.01,
    window: int = 16,
    lanes: int = 512,
) -> tuple[DataFrame, Counts, gru.Net]:
    """Counts of all given documents, as a table and as what tasks need, and the trained network."""
    counts = settle(word_counts(docs), "counts")
    known = gather(counts, vocabulary, listed)
    net = initial_net(known, hidden, width)
    rounds, shards = plan_rounds(known.tokens, shard_tokens)
    place = F.floor(_hashed("round") * rounds)
    for k in range(rounds):
        net = train_round(docs.filter(place == k), known, net, shards, rate, window, lanes)
    return counts, known, net


def _network_scores(net: gru.Net, docs: list[np.ndarray], most: int = 6_000_000) -> np.ndarray:
    """log10 of the network's probability of each document, many at a time so that lanes are full."""
    size = np.cumsum([0, *map(len, docs)])
    edge = np.unique(np.searchsorted(size, np.arange(0, size[-1], most)))
    parts = [gru.score(net, docs[a:b]) for a, b in zip(edge, [*edge[1:], len(docs)], strict=True)]
    return np.concatenate(parts) / np.log(10) if parts else np.zeros(0)


def score(docs: DataFrame, counts: DataFrame, known: Counts, net: gru.Net) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    context = docs.sparkSession.sparkContext
    sent, model = context.broadcast(known), context.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, net = sent.value, model.value
        counts = np.append(known.counts, 0).astype(float)
        for pdf in batches:
            texts, out, numbered = pdf["text"].tolist(), [], []
            for lo, hi in by_bytes(texts, 8_000_000):
                words, listed, docs = _documents(texts[lo:hi], known)
                numbered += docs
                more = np.log10(counts[listed] + 1)
                outside = np.append(known.number, gru.UNKNOWN)[listed] == gru.UNKNOWN
                end = float(known.counts[known.number == gru.END].sum())
                for k, d in enumerate(docs):
                    own = words.doc(k)
                    mine, apart = listed[own], outside[own]
                    rare, times = np.unique(words.hashes[own][mine < 0], return_counts=True)
                    base = more[own].sum() + np.log10(end + 1) - len(d) * np.log10(known.tokens + known.distinct + 1)
                    full = more[own][apart].sum() - apart.sum() * np.log10(known.outside)
                    out.append((len(d), int((mine >= 0).sum()) + int(end > 0), base, full, rare.view(np.int64), times))
            made = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score", "rare", "times"])
            made["score"] += _network_scores(net, numbered)
            yield made.assign(doc_id=pdf["doc_id"].to_numpy())

    schema = "n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>, doc_id string"
    made = docs.select(carried("doc_id").alias("doc_id"), "text").mapInPandas(run, schema)
    made = made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    made = settle(made.withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = made.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.times").alias("times")
    )
    more = (
        rare.join(counts, "word")  # words without a count add nothing
        .groupBy("row")
        .agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log"))
    )
    joined = made.drop("rare", "times").join(more, "row", "left")
    log = F.coalesce("log", F.lit(0.0))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + log).alias("base_score"),
        (F.col("score") + log).alias("score"),
    )


def held_out_scores(docs: DataFrame, **settings) -> DataFrame:
    """Learn from documents whose crc32(doc_id) mod 7 is not 2; score all."""
    counts, known, net = fit(docs.filter(remainder("doc_id", 7) != 2).select("doc_id", "text"), **settings)
    return score(docs, counts, known, net).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
