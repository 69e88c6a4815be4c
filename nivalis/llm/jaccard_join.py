"""N-gram Jaccard join: MinHash banding, then verification on full shingle sets.

A document's shingles are the hashes of its runs of `shingle` words (`[^\\x20\\x09-\\x0D]+`); a
document of fewer words, but not none, has one shingle of all its words.  Documents of equal
shingle sets form a class, and only one row of it goes on, as a node.  Band and row counts follow
from the wanted recall at the threshold.  Nodes that share a band are joined by edges to the
smallest of the band, never pairwise; the components of these edges are the candidate groups.

Pairs are verified exactly on full shingle sets, unit by unit.  A unit is a candidate group, or,
where a large group is only loosely chained, each band that its members share (a pair that shares
several counts in the first); whichever takes fewer copies of sets.  A unit is cut into blocks of
about `block` nodes: a block pair holds bit sets of its shingles and puts out only counts and a
spanning forest, so work spreads however large a unit is and no pair is ever a row.

Result, per input row: doc_id; class_id, the smallest doc_id that links of similarity >=
`threshold` lead to; n_links, the number of other documents within the threshold (copies
included); text_class, the smallest doc_id of the same shingle set.

Defined cases: null, empty and blank texts link to nothing (class_id is their own id); rows with a
null id are linked like others but never name a class, so class_id is null where no linked document
has an id, and text_class where none of the same set has; repeated rows are copies of each other; an
empty table gives an empty table.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivalis.llm.components import components, with_least
from nivalis.llm.tables import carried, discard, settle
from nivalis.llm.words import by_bytes, mix, split_words, window_hashes

_SEED = 77


def choose_bands(threshold: float, recall: float, max_hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, for which pairs at
    the threshold meet in some band with at least the wanted probability within `max_hashes`."""
    best = None
    for rows in range(1, max_hashes + 1):
        miss = 1 - threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(miss))) if miss > 0 else 1
        if bands * rows <= max_hashes:
            best = (max(1, bands), rows)
    if best is None:
        raise ValueError(f"no banding within {max_hashes} hashes reaches recall {recall}")
    return best


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(size, len(words))))


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = mix(shingles + np.uint64(1)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(shingles ^ np.uint64(_SEED)))
    return int(a.view(np.int64)), int(np.uint64(b).view(np.int64))


class MinHash:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(_SEED)
        self.bands, self.rows = bands, rows
        self.flip = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.times = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.weights = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """One key a band; keys of different bands differ."""
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        for lo in range(0, len(shingles), 2048):
            np.minimum(least, ((shingles[lo : lo + 2048, None] ^ self.flip) * self.times).min(axis=0), out=least)
        joined = (least.reshape(self.bands, self.rows) * self.weights).sum(axis=1, dtype=np.uint64)
        return mix(joined + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def _same_text() -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5("text")).alias("same")


def fingerprints(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, same, n, d1, d2, bands) of each (doc_id, text) row; `same` names the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        minhash = MinHash(bands, rows)
        for pdf in batches:
            texts, out = pdf["text"].tolist(), []
            for lo, hi in by_bytes(texts):
                words = split_words(texts[lo:hi])
                for k in range(hi - lo):
                    own = shingle_set(words.hashes[words.doc(k)], shingle)
                    out.append((len(own), *set_digest(own), minhash.keys(own) if len(own) else np.zeros(0, np.int64)))
            yield pd.DataFrame(out, columns=["n", "d1", "d2", "bands"]).assign(doc_id=pdf["doc_id"].to_numpy(), same=pdf["same"].to_numpy())

    made = docs.select(carried("doc_id").alias("doc_id"), _same_text(), "text")
    made = made.mapInPandas(run, "n long, d1 long, d2 long, bands array<long>, doc_id string, same binary")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """Each set as a bit row over the shingles that two sets at least hold."""
    sizes = [len(s) for s in sets]
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = (count > 1)[at]
    width = int(-(-max(1, (count > 1).sum()) // 64)) * 64
    row, col = np.repeat(np.arange(len(sets)), sizes)[shared], column[at][shared]
    edge = np.searchsorted(row, np.arange(0, len(sets) + 64, 64))
    out = np.zeros((len(sets), width // 64), dtype=np.uint64)
    for k in range(0, len(sets), 64):
        own = slice(edge[k // 64], edge[k // 64 + 1])
        flags = np.zeros((min(64, len(sets) - k), width), dtype=bool)
        flags[row[own] - k, col[own]] = True
        out[k : k + 64] = np.packbits(flags, axis=1).view(np.uint64)
    return out


def verify_block_pair(ids, weights, sets, side, threshold: float, earlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each node its weighted links across the two sides (within the one side if there is only
    one), and the smallest id that it is connected to there. Pairs with an equal key in the same
    column of `earlier` do not count."""
    n = len(ids)
    bits, sizes = _bits(sets), np.array([len(s) for s in sets])
    rows, cols = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(n), np.arange(n))
    linked = np.zeros((len(rows), len(cols)), dtype=bool)
    for k, i in enumerate(rows):
        common = np.bitwise_count(bits[cols] & bits[i]).sum(axis=1, dtype=np.int64) if len(cols) < 64 else _common(bits, cols, i)
        linked[k] = common * (1 + threshold) >= threshold * (sizes[i] + sizes[cols]) - 1e-9
        if earlier is not None:
            linked[k] &= ~(earlier[cols] == earlier[i]).any(axis=1)
    linked &= ids[rows][:, None] != ids[cols][None, :]
    links = np.zeros(n, dtype=np.int64)
    links[rows] += linked @ weights[cols]
    label = ids.copy()
    if side.any():
        links[cols] += linked.T @ weights[rows]
    top = np.iinfo(np.int64).max
    while True:
        before = label.copy()
        label[rows] = np.minimum(label[rows], np.where(linked, label[cols][None, :], top).min(axis=1, initial=top))
        label[cols] = np.minimum(label[cols], np.where(linked, label[rows][:, None], top).min(axis=0, initial=top))
        if (label == before).all():
            return links, label


def _common(bits: np.ndarray, cols: np.ndarray, i: int) -> np.ndarray:
    """Common shingles of set i with each of many, over the words where it has any."""
    where = np.flatnonzero(bits[i])
    picked = bits[i][where]
    out = np.zeros(len(cols), dtype=np.int64)
    for lo in range(0, len(cols), 512):
        out[lo : lo + 512] = np.bitwise_count(bits[np.ix_(cols[lo : lo + 512], where)] & picked).sum(axis=1, dtype=np.int64)
    return out


def _by_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of a sorted stream, whole."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.flatnonzero((pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(axis=1)) + 1
        edges = [0, *change.tolist(), len(pdf)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = pdf.iloc[a:b]
            if held and (held[-1][keys].iloc[-1].to_numpy() != part[keys].iloc[0].to_numpy()).any():
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """Nodes (node, same, weight, bands) with their shingle sets, each once: repeats of a text are
    reduced to one before they are shuffled."""
    rows = docs.select(_same_text(), "text").dropDuplicates(["same"]).join(nodes, "same").drop("same")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, found = pdf["text"].tolist(), []
            for lo, hi in by_bytes(texts):
                words = split_words(texts[lo:hi])
                found += [shingle_set(words.hashes[words.doc(k)], shingle) for k in range(hi - lo)]
            yield pdf[["node", "weight", "bands"]].assign(shingles=[s.tobytes() for s in found])

    return rows.mapInPandas(run, "node long, weight long, bands array<long>, shingles binary")


def verified_links(sets: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """(node, links, label) summed over block pairs. sets: node, weight, bands, shingles; units: node, band (-1: a whole candidate group), unit, blocks."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(
            F.least("block", j).alias("bi"), F.greatest("block", j).alias("bj"), (F.col("block") > j).cast("int").alias("side")
        ),
    )
    dealt = units.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets, "node").select("*", F.explode(pairs).alias("p"))
    dealt = dealt.select("band", "unit", "p.bi", "p.bj", "p.side", "node", "weight", F.when(F.col("band") > 0, F.slice("bands", 1, F.greatest("band", F.lit(1)))).alias("earlier"), "shingles")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _by_group(batches, ["band", "unit", "bi", "bj"]):
            ids, side = group["node"].to_numpy(np.int64), group["side"].to_numpy()
            sets = [np.frombuffer(s, dtype=np.uint64) for s in group["shingles"]]
            earlier = np.stack(group["earlier"].to_list()).astype(np.int64) if group["band"].iloc[0] > 0 else None
            links, label = verify_block_pair(ids, group["weight"].to_numpy(np.int64), sets, side, threshold, earlier)
            linked = links > 0
            yield pd.DataFrame({"node": ids[linked], "links": links[linked], "label": label[linked]})

    keys = ["band", "unit", "bi", "bj"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "node long, links long, label long")


def _units(groups: DataFrame, shared: DataFrame, block: int) -> DataFrame:
    """(node, band, unit, blocks) for verified_links. groups: node, component; shared: the bands of
    nodes that others share (node, band, key, n)."""
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    large = groups.join(sizes.filter(F.col("size") > block), "component")
    by_band = shared.join(large, "node").groupBy("component", "size").agg(F.sum(blocks("n")).alias("copies"))
    loose = by_band.filter(F.col("copies") < F.col("size") * blocks("size")).select("component")
    whole = groups.join(loose, "component", "left_anti").join(sizes, "component")
    apart = shared.join(large.join(loose, "component", "left_semi").select("node"), "node", "left_semi")
    return whole.select("node", F.lit(-1).alias("band"), F.col("component").alias("unit"), blocks("size").alias("blocks")).unionByName(
        apart.select("node", "band", F.col("key").alias("unit"), blocks("n").alias("blocks"))
    )


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    recall: float = 0.9999,
    block: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, class_id, n_links, text_class) for every row."""
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = settle(fingerprints(docs, shingle, bands, rows), "prints")
    filled = prints.filter("n > 0")
    classes = filled.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.min("same").alias("same"), F.count("*").alias("weight"), F.first("bands").alias("bands")
    )
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    met = classes.select(F.col("node").alias("v"), F.posexplode("bands").alias("band", "u"))
    shared = settle(with_least(met).filter("n > 1").withColumnsRenamed({"u": "key", "v": "node"}), "shared")
    groups = settle(components(shared.select(F.col("node").alias("u"), F.col("m").alias("v"))), "groups")
    units = _units(groups, shared, block)
    nodes = classes.join(groups.select("node"), "node", "left_semi").select("node", "same", "weight", "bands")
    links = settle(verified_links(_sets(docs, nodes, shingle), units, threshold), "links")
    discard(shared, groups)
    clusters = components(links.select(F.col("node").alias("u"), F.col("label").alias("v"))).withColumnRenamed("component", "cluster")
    least = clusters.join(classes.select("node", "rep"), "node").groupBy("cluster").agg(F.min("rep").alias("class"))
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("d1", "d2", "node", "rep", "weight").join(total, "node", "left").join(clusters.join(least, "cluster"), "node", "left")
    out = prints.select("doc_id", "n", "d1", "d2").join(known, ["d1", "d2"], "left")
    empty = F.col("n") == 0
    return out.select(
        F.col("doc_id").alias(id_col),
        F.when(empty, F.col("doc_id")).otherwise(F.coalesce("class", "rep")).alias("class_id"),
        F.when(empty, 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("rep")).alias("text_class"),
    )
