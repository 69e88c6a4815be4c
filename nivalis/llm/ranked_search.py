"""Ranked lexical search of benchmark items over all documents, by classes of equal bags.

Documents are restricted to the terms of the items: a document's bag is its vector of term counts
over that vocabulary.  A score depends on nothing but the bag and the length factor m, so documents
that agree in both form a class.  Classes are dealt out by a hash and told apart by all their bytes.
Each class is scored once, against all items, by an inverted list of the items' terms.  An item's best
classes are kept by (score, smallest doc_id); they are then expanded into members by ascending doc_id.
A document beyond an item's `k` best classes has at least `k` others before it, and so has one behind
the `k` smallest ids of its class; hence nothing that could be ranked is left out.

Terms are `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, with A-Z lower-cased.  With N documents
that hold a term, L terms in all of them, n in one, tf of one term in a document, df documents that
hold the term, a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 75 + 25 n N div L, and a
document's score is the sum over the item's terms, repeats included, of w (10^9 tf div (1000 tf + 12 m)).

The items are taken in blocks of about `block_bytes` of text.  A block is one pass over the documents;
it is sent to the tasks, and destroyed when its result is written.  A task holds one block, at most `k`
classes an item, and a bounded batch of scores.  Terms are found by a hash and then compared byte by byte.

Defined cases: null texts and texts without a term are never ranked; every row is a document, so
repeated rows are ranked each; a null doc_id comes last among equal scores; every row of the items is
an item of its own, null ids included; items without terms and empty tables give no rows.  Only the
named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nivalis.llm.piece_columns import runs
from nivalis.llm.tables import carried, discard, settle
from nivalis.llm.words import ALNUM_SEPARATORS, LOWER_AZ, HashTable, Words, by_bytes, split_words

_LAST = (1 << 63) - 1
#: Scores, and list entries, that a task works on at once.
_SCORES, _ENTRIES = 1_000_000, 2_000_000


@dataclass(frozen=True)
class Queries:
    """A block of items: its vocabulary and, by term, the items that hold it and how often."""

    table: HashTable  # hashes of the terms
    spelled: np.ndarray  # bytes of all terms, end to end
    begins: np.ndarray  # of each term in them
    sizes: np.ndarray
    edges: np.ndarray  # of each term's entries in the next two
    item: np.ndarray  # place of the item in `items`
    times: np.ndarray
    items: np.ndarray  # numbers of the items

    @staticmethod
    def of(rows: list[tuple[int, str | None]]) -> Queries:
        words = split_words([t for _, t in rows], ALNUM_SEPARATORS, LOWER_AZ)
        hashes, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        terms = [words.text(i) for i in first]
        if len({words.text(i) for i in range(len(words.hashes))}) != len(terms):
            raise ValueError("two terms of a block share a 64-bit hash; use another block_bytes")
        sizes = np.array([len(t) for t in terms], dtype=np.int64)
        owner = np.repeat(np.arange(len(rows)), np.diff(words.offsets))
        pair, times = np.unique(inverse * max(1, len(rows)) + owner, return_counts=True)
        term = pair // max(1, len(rows))
        return Queries(
            HashTable(hashes), np.frombuffer(b"".join(terms), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes,
            np.searchsorted(term, np.arange(len(terms) + 1)), pair % max(1, len(rows)), times, np.array([i for i, _ in rows], dtype=np.int64),
        )

    def find(self, words: Words) -> np.ndarray:
        """The term of each word, or -1."""
        out = self.table.find(words.hashes)
        at = np.flatnonzero(out >= 0)
        same = (words.ends - words.starts)[at] == self.sizes[out[at]]
        out[at[~same]] = -1
        at, k = at[same], 0
        while len(at):
            at = at[self.sizes[out[at]] > k]
            wrong = words.data[words.starts[at] + k] != self.spelled[self.begins[out[at]] + k]
            out[at[wrong]] = -1
            at, k = at[~wrong], k + 1
        return out


def bags(texts: list[str | None], queries: Queries) -> tuple[np.ndarray, list[bytes]]:
    """For each text its terms, with repeats, and its bag: pairs of a term of the items and its count."""
    words = split_words(texts, ALNUM_SEPARATORS, LOWER_AZ)
    n, term = np.diff(words.offsets), queries.find(words)
    owner = np.repeat(np.arange(len(texts)), n)
    width = max(1, len(queries.sizes))
    key, count = np.unique((owner * width + term)[term >= 0], return_counts=True)
    packed = np.stack((key % width, count), axis=1).astype("<i4")
    edge = np.searchsorted(key // width, np.arange(len(texts) + 1))
    return n, [packed[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _unpacked(packed: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, term, count) of all entries of some bags."""
    pairs = np.frombuffer(b"".join(packed), dtype="<i4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(packed)), [len(b) // 8 for b in packed]), pairs[:, 0], pairs[:, 1]


class Best:
    """The `k` best classes of every item among those seen so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, dtype=np.int64)
        self.held = [np.zeros(0, dtype=np.int64) for _ in range(5)]  # item, score, absent, first, class
        self.fresh: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, absent: np.ndarray, first: np.ndarray, classes: np.ndarray) -> None:
        c, item = np.nonzero(scores >= self.least)
        self.fresh.append([item, scores[c, item], absent[c], first[c], classes[c]])
        self.waiting += len(c)
        if self.waiting > self.k * len(self.least) + 50_000:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        item, score, absent, first, classes = (np.concatenate(x) for x in zip(self.held, *self.fresh, strict=True))
        order = np.lexsort((first, absent, -score, item))
        item = item[order]
        edge = np.searchsorted(item, np.arange(len(self.least) + 1))
        place = np.arange(len(item)) - edge[item]
        last = place == self.k - 1
        self.least[item[last]] = score[order][last]
        keep = order[place < self.k]
        self.held = [item[place < self.k], score[keep], absent[keep], first[keep], classes[keep]]
        self.fresh, self.waiting = [], 0
        return self.held


def score_classes(pdf: pd.DataFrame, queries: Queries, weights: np.ndarray, best: Best) -> None:
    """Score classes (class, m, absent, first, bag) against all items."""
    owner, term, tf = _unpacked(pdf["bag"])
    factor = 1_000_000_000 * tf // (1000 * tf + 12 * pdf["m"].to_numpy(np.int64)[owner])
    sizes = np.diff(queries.edges)[term]
    entries, n = np.cumsum(np.bincount(owner, weights=sizes, minlength=len(pdf)).astype(np.int64)), len(queries.items)
    edge = np.searchsorted(owner, np.arange(len(pdf) + 1))
    columns = [pdf[c].to_numpy(np.int64) for c in ("absent", "first", "class")]
    lo = 0
    while lo < len(pdf):
        done = entries[lo - 1] if lo else 0
        hi = int(np.searchsorted(entries, done + _ENTRIES, side="right"))
        hi = max(lo + 1, min(hi, lo + _SCORES // max(1, n), len(pdf)))
        own = slice(edge[lo], edge[hi])
        at = runs(queries.edges[term[own]], sizes[own])
        worth = np.repeat(factor[own] * weights[term[own]], sizes[own]) * queries.times[at]
        scores = np.zeros((hi - lo) * n, dtype=np.int64)
        np.add.at(scores, np.repeat(owner[own] - lo, sizes[own]) * n + queries.item[at], worth)
        best.add(scores.reshape(hi - lo, n), *(c[lo:hi] for c in columns))
        lo = hi


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        yield [(r["item"], r["text"]) for r in mine.select("item", "text").orderBy("item").toLocalIterator()]


def bag_table(docs: DataFrame, sent) -> DataFrame:
    """(id, n, bag) of all (id, text) rows with a term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in by_bytes(texts):
                n, packed = bags(texts[lo:hi], sent.value)
                yield pd.DataFrame({"id": pdf["id"].iloc[lo:hi].to_numpy(), "n": n, "bag": packed})[n > 0]

    return docs.mapInPandas(run, "id string, n long, bag binary")


def document_counts(held: DataFrame) -> DataFrame:
    """(term, df) over bags."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, dtype=np.int64)
        for pdf in batches:
            found = np.bincount(_unpacked(pdf["bag"])[1], minlength=len(total))
            found[: len(total)] += total
            total = found
        term = np.flatnonzero(total)
        yield pd.DataFrame({"term": term, "df": total[term]})

    return held.select("bag").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def classes_of(held: DataFrame, documents: int, terms: int, k: int, kind) -> DataFrame:
    """(class, m, bag, members, first, absent): documents of the same bag and m. Of a class only the `k`
    smallest ids travel, since no more can be ranked."""
    rows = held.filter(F.octet_length("bag") > 0).select(
        F.col("id").cast(kind).alias("id"), F.expr(f"75L + (25L * n * {documents}L) div {max(1, terms)}L").alias("m"), "bag"
    )
    rows = rows.withColumn("tag", F.xxhash64("m", "bag"))
    same = ["tag", "m", "bag"]
    first = Window.partitionBy(*same).orderBy(F.col("id").asc_nulls_last())
    few = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
    out = few.groupBy(*same).agg(F.collect_list(F.struct("id")).alias("members"), F.min("id").alias("first"))
    return out.select(
        F.monotonically_increasing_id().alias("class"), "m", "bag", "members",
        F.coalesce("first", F.lit(_LAST)).alias("first"), F.col("first").isNull().cast("long").alias("absent"),
    )


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 2_000_000,
) -> DataFrame:
    """(item id, rank, document id, score): the `k` best documents of every item with a score above 0."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    rows = docs.select(carried(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    asked = settle(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    results = []
    for block in _blocks(asked, block_bytes):
        queries = Queries.of(block)
        sent = spark.sparkContext.broadcast(queries)
        held = settle(bag_table(rows, sent), "bags")
        documents, terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(queries.sizes), dtype=np.int64)
        for term, df in document_counts(held).toLocalIterator():  # at most the block's terms
            weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        classes = settle(classes_of(held, documents, terms, k, kind), "classes")
        weighted = spark.sparkContext.broadcast(weights)

        def score(batches: Iterator[pd.DataFrame], sent=sent, weighted=weighted) -> Iterator[pd.DataFrame]:
            own = sent.value
            best = Best(len(own.items), k)
            for pdf in batches:
                score_classes(pdf, own, weighted.value, best)
            item, score, absent, first, number = best.settle()
            yield pd.DataFrame({"item": own.items[item], "score": score, "absent": absent, "first": first, "class": number})

        scored = classes.select("class", "m", "bag", "first", "absent").mapInPandas(score, "item long, score long, absent long, first long, class long")
        ahead = Window.partitionBy("item").orderBy(F.col("score").desc(), "absent", "first")
        top = scored.withColumn("place", F.row_number().over(ahead)).filter(F.col("place") <= k).select("item", "score", "class")
        ranked = top.join(classes.select("class", "members"), "class").select("item", "score", F.explode("members").alias("d"))
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("d.id").asc_nulls_last())
        ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = ranked.join(asked.select("item", "item_id"), "item")
        results.append(settle(out.select(F.col("item_id").alias(item_col), "rank", F.col("d.id").alias(id_col), "score"), "ranked"))
        discard(held, classes)
        sent.destroy()
        weighted.destroy()
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
