"""Toxicity by maximum-scoring segments of token log-odds.

Tokens (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z) get the log-odds of coming
from a toxic document.  Their rates are smoothed by a chain of Dirichlet priors: a word's prior is
the rate of its longest prefix, that prefix's prior the rate of the next shorter one, down to the
rate of all documents; a token not learnt scores as its longest learnt prefix.  Less a margin,
ordinary tokens score below zero, and a linear-time scan (Ruzzo and Tompa's stack) lists all
maximal-scoring segments of a document.

Scores of segments in clean text follow an extreme-value law, exp(-K n exp(-lambda S)) for n tokens.
lambda and K are fitted on clean documents kept from the log-odds; a segment is significant as far
as lambda S - ln(K n) exceeds zero.  The largest and the summed significance of a document go
through a logistic fit on the same documents, which gives the score.

Training reads at most about `max_labelled` labelled documents (chosen by hash of the id), so
labels are sent to the executors with a bounded size; the model keeps every feature that `min_docs`
of them hold, so that bound is the model's as well.

Defined cases: null and empty texts have no segment and get the score of a document without one;
without labels of both classes every score is 0; labels that repeat an id count as toxic if any
is; each row of the input gives one row.  Only doc_id and text (and labels.toxic) are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nivalis.llm.tables import carried, discard, remainder, settle
from nivalis.llm.words import ALNUM_SEPARATORS, LOWER_AZ, HashTable, Words, by_bytes, prefix_hashes, split_words

#: Bytes of the prefixes that back a word up.
PREFIXES = (4, 5, 6, 7, 8)
_ORDER = (*PREFIXES, 255)


@dataclass(frozen=True)
class LogOdds:
    table: HashTable
    scores: np.ndarray
    default: float


@dataclass(frozen=True)
class Calibration:
    lam: float
    log_k: float
    weights: np.ndarray  # of 1, largest significance, log of one plus summed significance


@dataclass(frozen=True)
class Model:
    odds: LogOdds
    calibration: Calibration | None


def _features(words: Words) -> dict[int, np.ndarray]:
    """Per level the feature hash of every word, 0 where the word is too short for the level."""
    return {n: prefix_hashes(words, n) for n in PREFIXES} | {255: words.hashes}


def _parents(features: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    out, last = {}, np.zeros(len(features[255]), dtype=np.uint64)
    for n in _ORDER:
        out[n] = last
        last = np.where(features[n] != 0, features[n], last)
    return out


def feature_counts(labelled: DataFrame) -> DataFrame:
    """(level, feature, parent, toxic, clean): documents of either class that hold a feature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, toxic = pdf["text"].tolist(), pdf["toxic"].to_numpy(bool)
            for lo, hi in by_bytes(texts, 8_000_000):
                words = split_words(texts[lo:hi], ALNUM_SEPARATORS, LOWER_AZ)
                doc = np.repeat(np.arange(hi - lo), np.diff(words.offsets))
                features = _features(words)
                parents = _parents(features)
                for n in _ORDER:
                    f = features[n]
                    has = np.flatnonzero(f != 0)
                    order = has[np.lexsort((doc[has], f[has]))]
                    once = np.ones(len(order), dtype=bool)
                    once[1:] = (f[order][1:] != f[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                    order = order[once]
                    key, first, count = np.unique(f[order], return_index=True, return_counts=True)
                    bad = np.add.reduceat(toxic[lo + doc[order]].astype(np.int64), first) if len(first) else count
                    yield pd.DataFrame({
                        "level": n, "feature": key.view(np.int64), "parent": parents[n][order][first].view(np.int64), "toxic": bad, "clean": count - bad,
                    })

    made = labelled.select("text", "toxic").mapInPandas(run, "level int, feature long, parent long, toxic long, clean long")
    return made.groupBy("level", "feature").agg(
        F.first("parent").alias("parent"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def fit_log_odds(labelled: DataFrame, strength: float, margin: float, min_docs: int) -> LogOdds | None:
    classes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not classes.get(True) or not classes.get(False):
        return None
    base = classes[True] / (classes[True] + classes[False])
    kept = settle(feature_counts(labelled).filter(F.col("toxic") + F.col("clean") >= min_docs), "features")
    number = [F.col(c).cast("int").alias(c) for c in ("toxic", "clean")]
    keys, rate = np.zeros(0, dtype=np.uint64), np.zeros(0)
    for n in _ORDER:
        own = kept.filter(F.col("level") == n).select("feature", "parent", *number).toPandas()  # one level at a time on the driver
        at = HashTable(keys).find(own["parent"].to_numpy(np.int64).view(np.uint64))
        prior = np.append(rate, base)[at]
        toxic, clean = own["toxic"].to_numpy(), own["clean"].to_numpy()
        keys = np.concatenate((keys, own["feature"].to_numpy(np.int64).view(np.uint64)))
        rate = np.concatenate((rate, (toxic + strength * prior) / (toxic + clean + strength)))
    rate = np.clip(rate, 1e-6, 1 - 1e-6)
    odds = np.log(rate / (1 - rate)) - np.log(base / (1 - base))
    return LogOdds(HashTable(keys), np.clip(odds, -2, 6) - margin, -margin)


def token_scores(words: Words, odds: LogOdds) -> np.ndarray:
    """Score of every word, by its most specific learnt feature."""
    out = np.full(len(words.hashes), odds.default)
    open_ = np.arange(len(out))
    features = _features(words)
    for n in reversed(_ORDER):
        at = odds.table.find(features[n][open_])
        at[features[n][open_] == 0] = -1
        out[open_[at >= 0]] = odds.scores[at[at >= 0]]
        open_ = open_[at < 0]
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score), in linear time.

    Runs of one sign are taken as a whole, which leaves the segments as they are. Each candidate
    keeps its running sum before and after it and the last earlier candidate with a smaller sum
    before; a new run joins those that it tops."""
    positive = scores > 0
    if not positive.any():
        return []
    edge = np.diff(np.concatenate(([0], positive.astype(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[list] = []  # begin, end, sum before, sum after, index of the last with a smaller sum before
    for b, e, before, after in zip(begins.tolist(), ends.tolist(), total[begins].tolist(), total[ends].tolist(), strict=True):
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append([b, e, before, after, j])
                break
            b, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e, after - before) for b, e, before, after, _ in stack]


def passages(text: str | None, model: Model) -> list[tuple[int, int, float]]:
    """Significant toxic passages of a text: first word, word after the last, and significance."""
    words = split_words([text], ALNUM_SEPARATORS, LOWER_AZ)
    if model.calibration is None:
        return []
    cal, n = model.calibration, len(words.hashes)
    found = maximal_segments(token_scores(words, model.odds))
    return [(b, e, x) for b, e, s in found if (x := cal.lam * s - cal.log_k - np.log(n)) > 0]


def _segment_sums(texts: list[str | None], odds: LogOdds) -> Iterator[tuple[int, list[float]]]:
    for lo, hi in by_bytes(texts):
        words = split_words(texts[lo:hi], ALNUM_SEPARATORS, LOWER_AZ)
        scores = token_scores(words, odds)
        for k in range(hi - lo):
            own = scores[words.doc(k)]
            yield len(own), [s for _, _, s in maximal_segments(own)]


def _summary(n: int, sums: np.ndarray, lam: float, log_k: float) -> tuple[float, float]:
    if not len(sums):
        return -10.0, 0.0
    x = lam * sums - log_k - np.log(max(n, 1))
    return float(np.clip(x.max(), -10, 60)), float(np.log1p(np.clip(x, 0, None).sum()))


def calibrate(labelled: DataFrame, odds: LogOdds) -> Calibration | None:
    """Fit on labelled documents that the log-odds have not seen; a few numbers of each reach the
    driver, which the bound on labelled documents bounds."""
    sent = labelled.sparkSession.sparkContext.broadcast(odds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = list(_segment_sums(pdf["text"].tolist(), sent.value))
            yield pd.DataFrame({"toxic": pdf["toxic"], "n": [n for n, _ in found], "sums": [s for _, s in found]})

    made = settle(labelled.select("text", "toxic").mapInPandas(run, "toxic boolean, n long, sums array<double>"), "segments")
    rows = made.select("toxic", "n", F.coalesce(F.array_max("sums"), F.lit(0.0)).alias("best")).toPandas()
    toxic = rows["toxic"].to_numpy(bool)
    if toxic.all() or not toxic.any():
        return None
    clean = rows[~toxic]
    best, n = clean["best"].to_numpy(float), clean["n"].to_numpy(float)
    lam = 1.0
    for _ in range(20):  # a Gumbel law of scale 1/lambda about (ln K + ln n) / lambda
        spread = np.std(best - np.log(np.maximum(n, 1)) / lam)
        lam = float(np.clip(np.pi / np.sqrt(6) / max(spread, 0.05), 0.1, 10))
    log_k = float(np.mean(lam * best - np.log(np.maximum(n, 1))) - np.euler_gamma)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = [_summary(k, np.asarray(s), lam, log_k) for k, s in zip(pdf["n"], pdf["sums"], strict=True)]
            yield pd.DataFrame(seen, columns=["largest", "summed"]).assign(toxic=pdf["toxic"].to_numpy())

    seen = made.mapInPandas(summed, "largest double, summed double, toxic boolean").toPandas()
    x, y = np.column_stack((np.ones(len(seen)), seen["largest"], seen["summed"])), seen["toxic"].to_numpy(float)
    w = np.zeros(3)
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(3), x.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Calibration(lam, log_k, w)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    strength: float = 3.0,
    margin: float = 3.0,
    min_docs: int = 3,
    max_labelled: int = 400_000,
) -> Model | None:
    """A model from documents (doc_id, text) and labels (doc_id, toxic). A fifth of the labelled
    documents serves calibration."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_labelled / n))
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most about max_labelled rows
    labelled = settle(labelled, "labelled")
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(5))
    odds = fit_log_odds(labelled.filter(fold != 0), strength, margin, min_docs)
    model = None if odds is None else Model(odds, calibrate(labelled.filter(fold == 0), odds))
    discard(labelled)
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, n_passages) for every row; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for pdf in batches:
            out = []
            if model is None or model.calibration is None:
                out = [(0.0, 0)] * len(pdf)
            else:
                cal = model.calibration
                for n, sums in _segment_sums(pdf["text"].tolist(), model.odds):
                    sums = np.asarray(sums)
                    z = float(cal.weights @ np.array([1.0, *_summary(n, sums, cal.lam, cal.log_k)]))
                    significant = (cal.lam * sums - cal.log_k - np.log(max(n, 1)) > 0).sum() if len(sums) else 0
                    out.append((1 / (1 + np.exp(-np.clip(z, -30, 30))), int(significant)))
            made = pd.DataFrame(out, columns=["score", "n_passages"])
            yield made.assign(doc_id=pdf["doc_id"].to_numpy(), predicted=(made["score"] >= threshold).astype(int))

    rows = docs.select(carried("doc_id").alias("doc_id"), "text")
    made = rows.mapInPandas(run, "doc_id string, score double, predicted int, n_passages long")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def held_out_scores(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Learn labels only of rows whose crc32(doc_id) mod 4 is not 2; score all documents."""
    model = fit(docs, labels.filter(remainder("doc_id", 4) != 2), **settings)
    return score(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "n_passages"
    )
