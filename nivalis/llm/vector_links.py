"""Near-duplicate vectors by product quantisation.

Equal vectors form a node; the rest works on nodes.  A coarse quantiser (k-means) deals unit vectors
into inverted lists, and a node's residual from its list's centre is coded by subspaces of `_WIDTH`
components, one byte each, beside the length of what the code leaves out.  A node then visits the
`probes` nearest lists.  There the asymmetric distance to every member is summed from a table of the
node's distances to all code words.  A member is dropped only if that distance exceeds the wanted one
by more than its code leaves out, so by the triangle inequality codes lose nothing; the cosine of the
others is computed in doubles on the vectors as given.

Only probing can lose links.  A pair is found if either of the two visits the other's list, and
`probes` is the least number for which this holds for a share `recall` of the sample's vectors, each
beside one at exactly the threshold in a random direction (closer ones are found more often).  The
coarse and the residual quantiser are fitted on at most `sample` nodes, those of the smallest hash;
every node is indexed and every node visits.

Work is dealt by unit: a list's members in blocks, its visitors in blocks.  Visitors travel to each
block of members and members to each block of visitors, a unit holds two blocks, and puts out link
counts and the smallest node that each of its nodes is connected to.  So no pair is ever a row, and a
list may hold any share of all rows.  Of a pair that meets once, both are credited there; if each
visits the other's list, each is credited where it visits.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, nor do vectors of different lengths with each other; equal vectors link; a null id counts as
a link of others, is never a component's name and is not kept; repeated rows are each others' links;
an empty table gives an empty table.  Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivalis.llm.components import components
from nivalis.llm.jaccard_join import _by_group
from nivalis.llm.tables import discard, settle

_SEED = 12
#: Components a subspace, code words of each, and lists at most.
_WIDTH, _WORDS, _LISTS = 4, 256, 2048
#: Visitors whose distance tables a task holds at once.
_TABLES = 256
#: What single precision may add to a distance.
_SLACK = 1e-4


def unit_vectors(packed: pd.Series, kind: str, width: int) -> np.ndarray:
    """Vectors of length 1 as rows of `width` doubles, zeros behind shorter ones."""
    out = np.zeros((len(packed), width))
    for row, b in zip(out, packed, strict=True):
        v = np.frombuffer(b, dtype=kind)
        row[: len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)  # squares of huge components stay finite
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, less each row's own square."""
    return (centres * centres).sum(axis=1) - 2 * (x @ centres.T)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = np.concatenate([_distances(x[a : a + 4096], centres).argmin(axis=1) for a in range(0, len(x), 4096)])
        count = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, weights=column, minlength=k) for column in x.T], axis=1)
        fresh = (total / np.maximum(count, 1)[:, None]).astype(np.float32)
        centres = np.where((count > 0)[:, None], fresh, x[rng.choice(len(x), k)])
    return centres


@dataclass(frozen=True)
class Quantiser:
    centres: np.ndarray  # of the lists
    words: np.ndarray  # (subspace, code word, component) of residuals
    probes: int

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The lists that each row visits, nearest first."""
        d = _distances(x, self.centres)
        near = np.argpartition(d, self.probes - 1, axis=1)[:, : self.probes]
        return np.take_along_axis(near, np.take_along_axis(d, near, axis=1).argsort(axis=1), axis=1)

    def code(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the lengths of what they leave out."""
        rest = x - self.centres[lists]
        codes = np.empty((len(x), len(self.words)), dtype=np.uint8)
        left = np.zeros(len(x))
        for m, words in enumerate(self.words):
            part = rest[:, m * _WIDTH : (m + 1) * _WIDTH]
            codes[:, m] = _distances(part, words).argmin(axis=1)
            left += ((part - words[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(left)

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        """(row, subspace, code word): squared distances of the rows' residuals from list `at`."""
        rest = x - self.centres[at]
        out = np.empty((len(x), *self.words.shape[:2]), dtype=np.float32)
        for m, words in enumerate(self.words):
            part = rest[:, m * _WIDTH : (m + 1) * _WIDTH]
            out[:, m] = _distances(part, words) + (part * part).sum(axis=1)[:, None]
        return out


def needed_probes(x: np.ndarray, centres: np.ndarray, threshold: float, recall: float, rng: np.random.Generator) -> int:
    """Lists to visit so that, of a row and one at the threshold from it, one visits the other's list
    for a share `recall` of the rows."""
    x = x[:8192]
    aside = rng.standard_normal(x.shape)
    aside -= (aside * x).sum(axis=1)[:, None] * x
    length = np.sqrt((aside * aside).sum(axis=1))[:, None]
    other = (threshold * x + math.sqrt(1 - threshold**2) * np.divide(aside, length, out=np.zeros_like(aside), where=length > 0)).astype(np.float32)
    a, b = _distances(x, centres), _distances(other, centres)
    row = np.arange(len(x))
    rank = np.minimum((a < a[row, b.argmin(axis=1)][:, None]).sum(axis=1), (b < b[row, a.argmin(axis=1)][:, None]).sum(axis=1))
    return int(np.quantile(rank, recall, method="higher")) + 1


def fit(x: np.ndarray, lists: int, threshold: float, recall: float) -> Quantiser:
    """x: unit vectors in single precision, their width a multiple of `_WIDTH`."""
    rng = np.random.default_rng(_SEED)
    centres = k_means(x, lists, 8, rng)
    probes = needed_probes(x, centres, threshold, recall, rng)
    own = np.concatenate([_distances(x[a : a + 4096], centres).argmin(axis=1) for a in range(0, len(x), 4096)])
    rest = (x - centres[own])[: 64 * _WORDS]
    words = [k_means(rest[:, a : a + _WIDTH], _WORDS, 6, rng) for a in range(0, x.shape[1], _WIDTH)]
    return Quantiser(centres, np.stack(words), probes)


def links_of_unit(q: Quantiser, at: int, threshold: float, visitors, members) -> tuple[np.ndarray, np.ndarray]:
    """Linked (visitor, member) places. Both come as dicts of columns; `vector` holds unit vectors."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    within = ((reach + _SLACK + members["left"]) ** 2).astype(np.float32)
    x, y = visitors["vector"], members["vector"]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo in range(0, len(x), _TABLES):
        some = x[lo : lo + _TABLES]
        table = q.tables(some.astype(np.float32), at)
        apart = np.zeros((len(some), len(y)), dtype=np.float32)
        for m in range(table.shape[1]):
            apart += table[:, m].take(members["code"][:, m], axis=1)
        i, j = np.nonzero(apart <= within)
        if 16 * len(i) > apart.size:
            cosine = (some @ y.T)[i, j]
        else:
            cosine = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", some[i[a : a + 65_536]], y[j[a : a + 65_536]]) for a in range(0, len(i), 65_536))])
        hit = (cosine >= threshold) & (visitors["node"][i + lo] != members["node"][j]) & (visitors["size"][i + lo] == members["size"][j])
        found.append((i[hit] + lo, j[hit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def smallest_connected(a: np.ndarray, b: np.ndarray, n: int, label: np.ndarray) -> np.ndarray:
    """The smallest label among the nodes that each of n nodes is connected to by the edges (a, b)."""
    label = label.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        if (label == before).all():
            return label


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def node_table(vectors: DataFrame) -> DataFrame:
    """(node, rep, weight, vector): distinct valid vectors of (vec_id, vector) rows."""
    found = vectors.filter(_valid(F.col("vector"))).groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    return found.withColumn("node", F.monotonically_increasing_id())


def _packed(nodes: DataFrame, kind: str) -> DataFrame:
    """(node, weight, size, vector as bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = [np.asarray(v, dtype=kind) for v in pdf["vector"]]
            yield pd.DataFrame({"node": pdf["node"], "weight": pdf["weight"], "size": [len(v) for v in packed], "vector": [v.tobytes() for v in packed]})

    return nodes.select("node", "weight", "vector").mapInPandas(run, "node long, weight long, size int, vector binary")


def indexed(packed: DataFrame, kind: str, width: int, sent) -> DataFrame:
    """The nodes with their list, the lists they visit, code, and what the code leaves out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                part = pdf.iloc[lo : lo + 2048]
                x = unit_vectors(part["vector"], kind, width).astype(np.float32)
                near = sent.value.nearest(x)
                codes, left = sent.value.code(x, near[:, 0])
                yield part.assign(list=near[:, 0], visits=list(near.astype(np.int32)), code=[c.tobytes() for c in codes], left=left)

    return packed.mapInPandas(run, "node long, weight long, size int, vector binary, list int, visits array<int>, code binary, left double")


def counted_links(index: DataFrame, kind: str, width: int, threshold: float, block: int, sent) -> DataFrame:
    """(node, links, label) summed over units."""
    blocks = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / block).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    visits = index.select(F.explode("visits").alias("at"), "node", "weight", "size", "vector", F.col("list").alias("home"))
    sizes = visits.groupBy("at").agg(blocks(F.count("*")).alias("visitor_blocks"))
    sizes = sizes.join(index.groupBy(F.col("list").alias("at")).agg(blocks(F.count("*")).alias("member_blocks")), "at")
    sizes = F.broadcast(sizes)  # one row a list, `_LISTS` at most
    visitors = visits.join(sizes, "at").select(
        "at", dealt(F.col("visitor_blocks")).alias("vb"), F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)).alias("mb"), F.lit(1).alias("role"),
        "node", "weight", "size", "vector", "home", F.lit(None).cast("array<int>").alias("visits"), F.lit(None).cast("binary").alias("code"), F.lit(0e0).alias("left"),
    )
    members = index.withColumnRenamed("list", "at").join(sizes, "at").select(
        "at", F.explode(F.sequence(F.lit(0), F.col("visitor_blocks") - 1)).alias("vb"), dealt(F.col("member_blocks")).alias("mb"), F.lit(0).alias("role"),
        "node", "weight", "size", "vector", F.col("at").alias("home"), "visits", "code", "left",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in _by_group(batches, ["at", "vb", "mb"]):
            is_member = unit["role"].to_numpy() == 0
            sides = []
            for part in (unit[~is_member], unit[is_member]):
                columns = {c: part[c].to_numpy(np.int64) for c in ("node", "weight", "size", "home")}
                sides.append(columns | {"vector": unit_vectors(part["vector"], kind, width), "left": part["left"].to_numpy()})
            visitors, members = sides
            if not len(visitors["node"]) or not len(members["node"]):
                continue
            members["code"] = np.frombuffer(b"".join(unit["code"][is_member]), dtype=np.uint8).reshape(len(members["node"]), -1)
            i, j = links_of_unit(sent.value, int(unit["at"].iloc[0]), threshold, visitors, members)
            if not len(i):
                continue
            where = np.stack(unit["visits"][is_member].to_list())
            both = np.zeros(len(i), dtype=bool)
            for lo in range(0, len(i), 65_536):
                both[lo : lo + 65_536] = (where[j[lo : lo + 65_536]] == visitors["home"][i[lo : lo + 65_536], None]).any(axis=1)
            nodes, place = np.unique(np.concatenate((visitors["node"], members["node"])), return_inverse=True)
            a, b = place[: len(visitors["node"])][i], place[len(visitors["node"]) :][j]
            links = np.zeros(len(nodes), dtype=np.int64)
            np.add.at(links, a, members["weight"][j])
            np.add.at(links, b[~both], visitors["weight"][i[~both]])
            label = smallest_connected(a, b, len(nodes), nodes)
            met = np.zeros(len(nodes), dtype=bool)
            met[a] = met[b] = True
            yield pd.DataFrame({"node": nodes[met], "links": links[met], "label": label[met]})

    keys = ["at", "vb", "mb"]
    return visitors.unionByName(members).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "node long, links long, label long")


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    recall: float = 0.999,
    sample: int = 65_536,
    block: int = 2048,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    nodes = settle(node_table(rows), "nodes")
    count, width = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    width = max(1, -(-width // _WIDTH)) * _WIDTH
    if count:
        packed = settle(_packed(nodes, kind), "packed")
        chosen = packed.orderBy(F.xxhash64("node"), "node").limit(sample).select("vector").toPandas()["vector"]
        lists = int(min(_LISTS, max(1, 2 * math.sqrt(count)), max(1, len(chosen) // 16)))
        sent = spark.sparkContext.broadcast(fit(unit_vectors(chosen, kind, width).astype(np.float32), lists, threshold, recall))
        index = settle(indexed(packed, kind, width, sent), "index")
        links = settle(counted_links(index, kind, width, threshold, block, sent), "links")
        discard(packed, index)
        sent.destroy()
    else:
        links = spark.createDataFrame([], "node long, links long, label long")
    clusters = components(links.select(F.col("node").alias("u"), F.col("label").alias("v"))).withColumnRenamed("component", "cluster")
    least = clusters.join(nodes.select("node", "rep"), "node").groupBy("cluster").agg(F.min("rep").alias("first"))
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(total, "node", "left").join(clusters.join(least, "cluster"), "node", "left")
    known = known.select("vector", "rep", "weight", "links", "first")
    out = rows.join(known, "vector", "left")
    component = F.when(F.col("weight").isNull(), F.col("vec_id")).otherwise(F.coalesce("first", "rep"))
    return out.select(
        F.col("vec_id").alias(id_col),
        F.when(F.col("weight").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
