"""Benchmark decontamination by suffix arrays over the training text.

The corpus is cut into shards (consecutive documents of about two megabytes).  Each shard gets a
suffix array over its words: suffix start positions sorted by the words that follow, `window`
words deep.  Every suffix of every benchmark item is then binary-searched in it; the range found
holds all places where its next `window` words occur verbatim.  Places that follow each other on
one diagonal (same item, same distance between the place in the document and the place in the
item) are joined, which gives the longest verbatim matches.  Positions whose first words begin no
benchmark suffix cannot be found by any search and are left out of the array.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  A window is `window`
consecutive words of an item; an item with fewer words, but not none, is one window.

Defined cases: a null or empty text has no words and no hits; an empty benchmark hits nothing;
repeated documents are each reported; items that repeat are each named; null item ids are
ignored.  Only the named columns are read.

The benchmark is cut into blocks of about `block_bytes` of text, with one pass over the documents
per block.  A task and the driver hold one block at a time.  With several blocks the benchmark is
written once, sorted by block; the hits of a pass are written and its block is destroyed before the
next one is read.

Words are told apart by 64 bits: that any of v words of a benchmark equals another one of V words of
the corpus is expected v V / 2^64 times (5e-5 for 10^6 and 10^9), and the other words of the window
must match as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nivalis.llm.tables import carried, discard, settle
from nivalis.llm.words import ALNUM_SEPARATORS, LOWER_AZ, HashTable, by_bytes, split_words, window_hashes

#: Leading words by which positions are admitted to a suffix array.
_LEAD = 3
_MATCH = ("item", "item_begin", "begin", "n_words")
_MATCHES = "array<struct<item:string,item_begin:int,begin:int,n_words:int>>"


@dataclass(frozen=True)
class TestSuffixes:
    """Suffixes of a block of benchmark items, cut to the window, grouped by their length."""

    words: HashTable  # vocabulary of the block; positions in it plus one are word numbers
    lead: dict[int, HashTable]  # by lead length: hashes of the first words of the suffixes
    names: list[str]  # of the items
    keys: dict[int, np.ndarray]  # by suffix length: sorted distinct word numbers, as bytes
    edges: dict[int, np.ndarray]  # where each key's suffixes begin in the next two, and the end
    item: dict[int, np.ndarray]  # the item of each suffix
    place: dict[int, np.ndarray]  # and its place in it


def _as_bytes(numbers: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike. Numbers are stored plus one, so no
    byte string loses trailing zeros that matter."""
    wide = np.ascontiguousarray(numbers.astype(">u4"))
    return wide.view(f"S{4 * wide.shape[1]}").ravel()


def test_suffixes(items: list[tuple[str, str | None]], window: int) -> TestSuffixes:
    split = split_words([t for _, t in items], ALNUM_SEPARATORS, LOWER_AZ)
    words = HashTable(np.unique(split.hashes))
    sizes = np.diff(split.offsets)
    leads, keys, edges, item, place = {}, {}, {}, {}, {}
    for length in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
        own = np.flatnonzero(np.minimum(sizes, window) == length)
        counts = sizes[own] - length + 1
        of = np.repeat(own, counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = split.offsets[of] + at
        numbers = words.find(split.hashes) + 1
        keys[length], inverse = np.unique(_as_bytes(numbers[starts[:, None] + np.arange(length)]), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        edges[length] = np.searchsorted(inverse[order], np.arange(len(keys[length]) + 1))
        item[length], place[length] = of[order].astype(np.int32), at[order].astype(np.int32)
        lead = min(_LEAD, length)
        leads.setdefault(lead, []).append(window_hashes(split.hashes, lead)[starts])
    return TestSuffixes(
        words, {n: HashTable(np.unique(np.concatenate(x))) for n, x in leads.items()}, [i for i, _ in items], keys, edges, item, place
    )


def suffix_array(numbers: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The given starts sorted by their next `depth` word numbers, with those as byte strings.
    Number 0 stands for words outside the benchmark and for what lies past the end."""
    padded = np.concatenate((numbers, np.zeros(depth, dtype=numbers.dtype)))
    following = _as_bytes(padded[starts[:, None] + np.arange(depth)])
    order = np.argsort(following, kind="stable")
    return starts[order], following[order]


def _spans(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as disjoint intervals."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([True], begins[1:] > reach[:-1]))
    return begins[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(begins) - 1)]


Match = tuple[str, int, int, int]


def _longest(test: TestSuffixes, hits: list[tuple[int, np.ndarray, np.ndarray]]) -> list[Match]:
    """Longest matches (item, place in it, place in the document, words) of one document, from its
    places in rising order and the keys found there, for each key length."""
    out = []
    for length, places, keys in hits:
        edges, item, place = test.edges[length], test.item[length], test.place[length]
        of = {k: list(zip(item[a:b].tolist(), place[a:b].tolist(), strict=True)) for k, a, b in ((k, edges[k], edges[k + 1]) for k in np.unique(keys).tolist())}
        runs: dict[tuple[int, int], list[int]] = {}  # first and last place of the run open on each diagonal
        done = []
        for p, k in zip(places.tolist(), keys.tolist(), strict=True):
            for i, q in of[k]:
                run = runs.get((i, p - q))
                if run is not None and run[1] == p - 1:
                    run[1] = p
                else:
                    runs[i, p - q] = run = [p, p]
                    done.append((i, p - q, run))
        out += [(test.names[i], a - d, a, b - a + length) for i, d, (a, b) in done]
    return sorted(out, key=lambda m: (m[2], -m[3], m[0], m[1]))


def search_shard(texts: list[str | None], test: TestSuffixes) -> list[tuple[int, np.ndarray, np.ndarray, list[Match]]]:
    """For each text: its words, begins and ends of hit words, and the longest matches."""
    split = split_words(texts, ALNUM_SEPARATORS, LOWER_AZ)
    owner_end = np.repeat(split.offsets[1:], np.diff(split.offsets))
    found: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in texts]
    numbers = None
    for length, keys in test.keys.items():
        lead = min(_LEAD, length)
        admitted = np.flatnonzero(test.lead[lead].find(window_hashes(split.hashes, lead)) >= 0)
        admitted = admitted[admitted + length <= owner_end[admitted]]
        if not len(admitted):
            continue
        if numbers is None:
            numbers = test.words.find(split.hashes) + 1
        places, following = suffix_array(numbers, admitted, length)
        low, high = np.searchsorted(following, keys, "left"), np.searchsorted(following, keys, "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        places = np.concatenate([places[low[k] : high[k]] for k in hit])
        of = np.repeat(hit, (high - low)[hit])
        order = np.argsort(places)
        places, of = places[order], of[order]
        doc = np.searchsorted(split.offsets, places, side="right") - 1
        edge = np.flatnonzero(np.diff(doc)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(doc)], strict=True):
            found[doc[a]].append((length, places[a:b] - split.offsets[doc[a]], of[a:b]))
    out, none = [], np.zeros(0, np.int64)
    for k, hits in enumerate(found):
        begins, ends = none, none
        if hits:
            begins = np.concatenate([p for _, p, _ in hits])
            begins, ends = _spans(begins, begins + np.concatenate([np.full(len(p), n) for n, p, _ in hits]))
        out.append((int(split.offsets[k + 1] - split.offsets[k]), begins, ends, _longest(test, hits)))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[int, DataFrame]:
    """The number of blocks, and the benchmark as (block, item, text), by block if there are several."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).dropna().distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int"))
    return blocks, settle(rows.orderBy("block"), "blocks") if blocks > 1 else rows


def _searched(rows: DataFrame, sent: Broadcast) -> DataFrame:
    """Rows (row, id, text) searched for a block of suffixes."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            found = [x for lo, hi in by_bytes(texts) for x in search_shard(texts[lo:hi], sent.value)]
            yield pd.DataFrame({
                "row": pdf["row"],
                "id": pdf["id"],
                "n_words": [x[0] for x in found],
                "begins": [x[1].astype(np.int32) for x in found],
                "ends": [x[2].astype(np.int32) for x in found],
                "items": [sorted({m[0] for m in x[3]}) for x in found],
                "matches": [[dict(zip(_MATCH, m, strict=True)) for m in x[3]] for x in found],
            })

    return rows.mapInPandas(search, f"row long, id string, n_words long, begins array<int>, ends array<int>, items array<string>, matches {_MATCHES}")


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 8_000_000,
) -> DataFrame:
    """One row per input row: (id, n_words, begins, ends, items, matches). Words begins[i]..ends[i]-1
    are covered by matches; `matches` lists the longest ones, each with its item, its place in the
    item and in the document, and its words. With several blocks, rows get a written key to be merged by."""
    rows = docs.select(F.lit(0).cast("long").alias("row"), carried(id_col).alias("id"), F.col(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    blocks, items = _blocks(benchmark, item_col, item_text_col, block_bytes)
    if blocks == 1:
        block = [(r["item"], r["text"]) for r in items.toLocalIterator()]
        out = _searched(rows, context.broadcast(test_suffixes(block, window))).drop("row")
    else:
        rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        passes = []
        for k in range(blocks):
            block = [(r["item"], r["text"]) for r in items.filter(F.col("block") == k).toLocalIterator()]
            sent = context.broadcast(test_suffixes(block, window))
            found = _searched(rows, sent)  # the first pass keeps all rows, the others those with hits
            passes.append(settle(found.filter(F.size("items") > 0) if k else found, "found"))
            sent.destroy()
        discard(rows, items)
        out = reduce(DataFrame.unionByName, passes)
        merged = out.groupBy("row").agg(
            F.first("id").alias("id"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list(F.arrays_zip("begins", "ends")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.flatten(F.collect_list("matches")).alias("matches"),
        )
        empty = F.lit(None).cast("array<struct<begins:int,ends:int>>")
        last = lambda acc: F.element_at(acc, -1)
        joined = F.aggregate(
            "spans",
            F.coalesce(empty, F.array().cast("array<struct<begins:int,ends:int>>")),
            lambda acc, x: F.when(
                (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["ends"] >= x["begins"]),
                F.concat(
                    F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                    F.array(F.struct(last(acc)["begins"].alias("begins"), F.greatest(last(acc)["ends"], x["ends"]).alias("ends"))),
                ),
            ).otherwise(F.concat(acc, F.array(x))),
        )
        out = merged.withColumn("spans", joined).select("id", "n_words", "spans.begins", "spans.ends", "items", "matches")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "begins", "ends", "items", "matches")


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of each document of `matches`."""
    covered = F.aggregate(F.zip_with("ends", "begins", lambda e, b: (e - b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )
