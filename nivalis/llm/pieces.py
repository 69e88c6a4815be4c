"""SentencePiece encoding and decoding over a lattice of substrings.

A text becomes `\u2581` plus itself with spaces as `\u2581`, cut before every run of `\u2581` that
follows another character; no piece crosses such a cut, so each unit can be encoded alone.  Every
substring of a unit, up to the longest piece's length, is looked up in the piece table; the edges
found are grouped by unit and folded into a segmentation.  Two folds are given:

- `viterbi`: the segmentation of the largest score sum, for unigram models;
- `merges`: replays the model's merges (best piece first, leftmost among equals) over the lattice,
  for BPE models, whose scores are ranks; there the largest sum is not what the model means, and
  only this fold gives the library's ids.

and two styles:

- `lattice`: relational. Distinct units are exploded into substrings and equi-joined to the piece
  table, edges are grouped by unit, a Spark higher-order aggregate folds them, and the encodings go
  back to the texts by joins;
- `columns`, the default, as the former costs too much on large vocabularies of units (figures in
  the README): the same lattice and the `merges` fold as numpy columns, for the units that a task
  meets. A task keeps encodings of at most `_KEPT` units. Nothing is shuffled.

Units of more than `_LONG` characters, for which a fold is quadratic, are merged with a heap. Units
of a task are told apart by 64-bit hashes. Both styles give the same ids.  Characters without a piece
become their UTF-8 bytes' pieces.  Decoding joins nothing: a constant array maps ids to bytes.

Defined cases: null and empty texts have no ids; repeated rows are encoded each; ids out of range
and control ids decode to nothing; an empty table gives an empty table; only the named columns are
read, so extra ones cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.llm import piece_columns as columns
from nivalis.llm.words import by_bytes

MARK = "▁"
_LONG = 40
_KEPT = 400_000
_NEVER = 1 << 30


@dataclass(frozen=True)
class Model:
    """The pieces that text can become, in order of id; `first_byte` is the id of byte 0."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    first_byte: int
    longest: int


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.get_piece_size())
    normal = tuple(not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) for i in ids)
    pieces = tuple(p.id_to_piece(i) for i in ids)
    return Model(
        pieces, tuple(p.get_score(i) for i in ids), normal, p.piece_to_id("<0x00>"), max(len(x) for x, n in zip(pieces, normal, strict=True) if n)
    )


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, id, rank, score): rank orders merges, best first; equal scores have equal ranks."""
    rows = [(p, i, rank, model.scores[i]) for p, (rank, i) in _ranked(model).items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "id", "rank", "score"]), "piece string, id int, rank int, score double")


def distinct_units(texts: DataFrame) -> DataFrame:
    """(unit, text, n) of all (text) rows."""
    units = texts.select(F.explode(_units(F.col("text"))).alias("text"))
    return units.groupBy("text").agg(F.count("*").alias("n")).select(F.xxhash64("text").alias("unit"), "text", "n")


def _units(text: Column) -> Column:
    """A text's units in order; none of an empty or null text."""
    marked = F.concat(F.lit(MARK), F.translate(text, " ", MARK))
    found = F.regexp_extract_all(marked, F.lit(f"{MARK}+[^{MARK}]*"), 0)
    return F.when(F.length(text) > 0, found).otherwise(F.array().cast("array<string>"))


def lattice(units: DataFrame, pieces: DataFrame, longest: int, values: tuple[str, ...] = ("rank", "score")) -> DataFrame:
    """(unit, text, n, edges): for every unit the pieces at its places, as (begin, size, id, values...)."""
    size = F.length("text")
    places = F.flatten(
        F.transform(
            F.sequence(F.lit(0), size - 1),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(longest), size - i)), lambda n: F.struct(i.alias("begin"), n.alias("size"))
            ),
        )
    )
    some = units.filter(size > 0).select("unit", "text", "n", F.explode(places).alias("at"))
    some = some.withColumn("piece", F.expr("substring(text, at.begin + 1, at.size)"))
    head = (F.col("at.begin") == 0) & (F.col("at.size") == 1)  # carries what a unit's rows have in common
    slim = some.select(
        "unit", "piece", "at", F.when(head, F.col("text")).alias("text"), F.when(head, F.col("n")).alias("n")
    )
    found = slim.join(F.broadcast(pieces), "piece", "left")  # as large as the vocabulary
    found = found.filter(F.col("id").isNotNull() | F.col("text").isNotNull())
    edge = F.when(F.col("id").isNotNull(), F.struct(F.col("at.begin").alias("begin"), F.col("at.size").alias("size"), "id", *values))
    return found.groupBy("unit").agg(F.max("text").alias("text"), F.max("n").alias("n"), F.collect_list(edge).alias("edges"))


def _bound(value: Column, use) -> Column:
    """Evaluate a column once and use it in an expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_merges(edges: Column, size: Column) -> Column:
    """Ends of the segments, 0 first: adjacent segments merge, best rank first, leftmost among equals."""
    ranks = F.map_from_arrays(
        F.transform(edges, lambda e: e["begin"] * 4096 + e["size"]), F.transform(edges, lambda e: e["rank"])
    )

    def best(cuts: Column, ranked: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(cuts) - 3),
            lambda k: F.struct(
                F.coalesce(ranked[F.get(cuts, k) * 4096 + F.get(cuts, k + 2) - F.get(cuts, k)], F.lit(_NEVER)).alias("rank"),
                k.alias("k"),
            ),
        )
        return F.array_min(pairs)

    def step(cuts: Column, ranked: Column) -> Column:
        merged = _bound(
            best(cuts, ranked),
            lambda m: F.when(m["rank"] < _NEVER, F.filter(cuts, lambda _, i: i != m["k"] + 1)).otherwise(cuts),
        )
        return F.when(F.size(cuts) < 3, cuts).otherwise(merged)

    start = F.sequence(F.lit(0), size)
    rounds = F.when(size > 1, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))
    return _bound(ranks, lambda ranked: F.aggregate(rounds, start, lambda cuts, _: step(cuts, ranked)))


def fold_viterbi(edges: Column, size: Column, unknown: float) -> Column:
    """Ends of the segments, 0 first, of the largest score sum; a character without a piece costs
    `unknown`. Among equal sums the longer last piece wins."""
    kind = "array<struct<total:double,back:int>>"
    start = F.array(F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("back"))).cast(kind)

    def step(best: Column, end: Column) -> Column:
        here = F.filter(edges, lambda e: e["begin"] + e["size"] == end)
        sums = F.transform(
            here, lambda e: F.struct((F.get(best, e["begin"])["total"] + e["score"]).alias("total"), e["size"].alias("back"))
        )
        plain = F.array(F.struct((F.get(best, end - 1)["total"] + unknown).alias("total"), F.lit(1).alias("back")))
        options = F.when(F.exists(here, lambda e: e["size"] == 1), sums).otherwise(F.concat(sums, plain))
        return F.concat(best, F.array(F.array_max(options))).cast(kind)

    def trace(best: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), size),
            F.array(size),
            lambda cuts, _: F.when(F.get(cuts, F.lit(0)) == 0, cuts).otherwise(
                F.concat(F.array(F.get(cuts, F.lit(0)) - F.get(best, F.get(cuts, F.lit(0)))["back"]), cuts)
            ),
        )

    return _bound(F.aggregate(F.sequence(F.lit(1), size), start, step), trace)


def segment_ids(text: Column, cuts: Column, edges: Column, first_byte: int) -> Column:
    """Piece ids of the segments between cuts; bytes for a character that is no piece."""
    ids = F.map_from_arrays(F.transform(edges, lambda e: e["begin"] * 4096 + e["size"]), F.transform(edges, lambda e: e["id"]))

    def one(k: Column, known: Column, at: Column) -> Column:
        begin, size = F.get(at, k), F.get(at, k + 1) - F.get(at, k)
        code = F.hex(F.encode(F.substring(text, begin + 1, size), "UTF-8"))
        spelled = F.transform(
            F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1),
            lambda j: F.conv(F.substring(code, 2 * j + 1, F.lit(2)), 16, 10).cast("int") + first_byte,
        )
        piece = known[begin * 4096 + size]
        return F.when(piece.isNotNull(), F.array(piece)).otherwise(spelled)

    return _bound(
        F.struct(ids.alias("ids"), cuts.alias("cuts")),
        lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["cuts"]) - 2), lambda k: one(k, x["ids"], x["cuts"]))),
    )


def merge_with_heap(text: str, ranks: dict[str, tuple[int, int]], first_byte: int) -> list[int]:
    """Merges of one unit, for units too long to fold."""
    end = list(range(1, len(text) + 1))
    previous, alive = list(range(-1, len(text) - 1)), [True] * len(text)
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if end[i] < len(text) and (found := ranks.get(text[i : end[end[i]]])):
            heapq.heappush(heap, (found[0], i, end[end[i]]))

    for i in range(len(text)):
        offer(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or end[i] >= len(text) or end[end[i]] != to:
            continue
        alive[end[i]] = False
        end[i] = to
        if to < len(text):
            previous[to] = i
        offer(i)
        if previous[i] >= 0:
            offer(previous[i])
    out, i = [], 0
    while i < len(text):
        found = ranks.get(text[i : end[i]])
        out += [found[1]] if found else [first_byte + b for b in text[i : end[i]].encode("utf-8", "surrogatepass")]
        i = end[i]
    return out


def _ranked(m: Model) -> dict[str, tuple[int, int]]:
    """Rank and id of each piece; the best has rank 0, equal scores have equal ranks."""
    order = {s: k for k, s in enumerate(sorted({s for s, n in zip(m.scores, m.normal, strict=True) if n}, reverse=True))}
    return {p: (order[s], i) for i, (p, s, n) in enumerate(zip(m.pieces, m.scores, m.normal, strict=True)) if n}


def encode_units(units: DataFrame, path: str, fold: str = "merges") -> DataFrame:
    """(unit, text, n, ids) of distinct units, relationally: explode, equi-join, group and fold."""
    model = load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = load(path)
        ranks = _ranked(m)
        for pdf in batches:
            yield pdf.assign(ids=[merge_with_heap(t, ranks, m.first_byte) for t in pdf["text"]])

    normal = [s for s, n in zip(model.scores, model.normal, strict=True) if n]
    short = units.filter(F.length("text") <= _LONG) if fold == "merges" else units
    grid = lattice(short, piece_table(units.sparkSession, model), model.longest, ("rank",) if fold == "merges" else ("score",))
    size = F.length("text")
    cuts = fold_merges(F.col("edges"), size) if fold == "merges" else fold_viterbi(F.col("edges"), size, min(normal) - 10)
    out = grid.withColumn("cuts", cuts).select(
        "unit", "text", "n", segment_ids(F.col("text"), F.col("cuts"), F.col("edges"), model.first_byte).alias("ids")
    )
    if fold != "merges":
        return out
    long = units.filter(F.length("text") > _LONG).select("unit", "text", "n")
    return out.unionByName(long.mapInPandas(run, "unit long, text string, n long, ids array<int>"))


def decoded(ids: Column, path: str) -> Column:
    """The text that ids spell, with `\\u2581` for spaces."""
    model = load(path)
    spelled = [
        p.encode().hex() if n else (f"{i - model.first_byte:02x}" if 0 <= i - model.first_byte < 256 else "")
        for i, (p, n) in enumerate(zip(model.pieces, model.normal, strict=True))
    ]
    table = F.split(F.lit(",".join(spelled)), ",")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(table, i), F.lit(""))), "")), "UTF-8")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the decoded text: spaces restored, the space put before every text taken off."""
    plain = F.translate(decoded(F.col(ids_col), path), MARK, " ")
    return encoded.withColumn(text_col, F.regexp_replace(plain, "^ ", ""))


class Encoder:
    """Ids of batches of texts; keeps the encodings of units it has met."""

    def __init__(self, path: str):
        m = load(path)
        self.ranks, self.first_byte = _ranked(m), m.first_byte
        names = list(self.ranks)
        rank, ids = np.array([self.ranks[p] for p in names], dtype=np.int64).T
        self.pieces = columns.Pieces(names, ids, rank, m.first_byte)
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ids, self.begins, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, units: columns.Units, which: np.ndarray) -> None:
        long = units.sizes[which] > _LONG
        short, tall = which[~long], which[long]
        ids, sizes = columns.encode(units.codes[columns.runs(units.begins[short], units.sizes[short])], units.sizes[short], self.pieces)
        parts = [self.ids, ids]
        for i in tall:
            text = units.codes[units.begins[i] : units.begins[i] + units.sizes[i]].tobytes().decode("utf-32-le", "surrogatepass")
            parts.append(np.array(merge_with_heap(text, self.ranks, self.first_byte), dtype=np.int32))
        sizes = np.concatenate((sizes, [len(x) for x in parts[2:]])).astype(np.int64)
        self.place.update(zip(units.hashes[np.concatenate((short, tall))].tolist(), range(len(self.sizes), len(self.sizes) + len(which)), strict=True))
        self.begins = np.concatenate((self.begins, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate(parts)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and how many each has."""
        if len(self.place) > _KEPT:
            self.forget()
        units = columns.Units(texts)
        keys, first, own = np.unique(units.hashes, return_index=True, return_inverse=True)
        names = keys.tolist()
        self._learn(units, first[[k not in self.place for k in names]] if names else first)
        at = np.fromiter(map(self.place.__getitem__, names), dtype=np.int64, count=len(names))[own]
        total = np.concatenate(([0], np.cumsum(self.sizes[at])))
        return self.ids[columns.runs(self.begins[at], self.sizes[at])], np.diff(total[units.offsets])


def _in_columns(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in by_bytes(texts):
                ids, sizes = encoder([t or "" for t in texts[lo:hi]])
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), made], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def _by_joins(docs: DataFrame, path: str, fold: str) -> DataFrame:
    """Distinct texts and distinct units are encoded once; equal texts meet by two hashes."""
    keyed = docs.withColumns({"th": F.xxhash64("text"), "tm": F.crc32(F.encode("text", "UTF-8"))})
    texts = keyed.filter(F.length("text") > 0).groupBy("th", "tm").agg(F.first("text").alias("text"))
    encoded = encode_units(distinct_units(texts), path, fold).select(F.col("text").alias("unit"), "ids")
    places = texts.select("th", "tm", F.posexplode(_units(F.col("text"))).alias("k", "unit"))
    met = places.join(encoded, "unit").groupBy("th", "tm")
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]))
    whole = keyed.drop("text").join(met.agg(ids.alias("ids")), ["th", "tm"], "left")
    return whole.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def encode(
    docs: DataFrame, path: str, fold: str = "merges", style: str = "columns", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids) for every row. The style `columns` has the fold `merges` only."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if style == "columns" and fold != "merges":
        raise ValueError("style 'columns' replays merges; use style 'lattice'")
    out = _in_columns(docs, path) if style == "columns" else _by_joins(docs, path, fold)
    return out.withColumnRenamed("doc_id", id_col)
