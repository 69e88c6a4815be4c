"""Alignment of two tokenizers' tokens over the bytes of a text, for documents of any length.

A text, with a space before it, is encoded by a byte-level vocabulary (A) and by a piece vocabulary
(B, which adds that space itself).  Places where tokens of both end cut the tokens into groups; an A
token and a B token whose bytes overlap are linked.  A pair of ids counts as many documents as hold it
linked; each document is told how many of its links carry the highest count of their A id, and the sum
of the counts of all its links.

Parts of a text are fragments: an open prefix (the tokens up to the first common end), closed groups,
an open suffix (the tokens after the last).  Fragments of neighbouring parts compose: the suffix of one
and the prefix of the next are read together, and the groups that close there are put out.  The result
depends only on the tokens, however they were cut, so composing is associative; the part without a
token is its identity.

A document of more than `chunk` bytes is cut at every multiple of `chunk`.  Each vocabulary moves a cut
to its own next safe place: A to a space between two visible characters, where a pre-token always
begins; B to a run of spaces, which no piece crosses.  So the tokens of a part are those of the whole
text, but the two streams end at different bytes.  Parts are dealt over tasks and encoded there, and
fragments meet in a tree, `fan` neighbours a step, in which only open prefixes and suffixes travel.
Closed groups stay in a table of pieces, from which sums and the digest of a document are taken, the
latter by streaming its pieces in order.

Shorter documents are cut at the places that are safe for both; what lies between is a unit, whose
prefix and suffix are closed by themselves.  Units repeat a lot, so a task keeps those that it has met.

The table of pair counts is sent to the tasks if it has at most `kept_pairs` rows, else it is joined.

Defined cases: null and empty texts, and those whose tokens do not spell the text in either vocabulary,
have no tokens: zeros and an empty digest.  Repeated rows and null ids are documents of their own; an
empty table gives an empty table.  Special strings are plain text.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nivalis.llm.jaccard_join import _by_group
from nivalis.llm.piece_columns import runs
from nivalis.llm.tables import carried, discard, settle
from nivalis.llm.words import by_bytes

#: Before a single space between two visible characters.
_CUT_A = re.compile(r"(?<=[\w.,;:!?|%&*$#)-])(?= \w)")
#: Before a run of spaces.
_CUT_B = re.compile(r"(?<=[^ ])(?= )")
#: Units that a task keeps, and pairs that it counts before it puts them out.
_KEPT, _COUNTED = 400_000, 2_000_000


# -- vocabularies


@dataclass(frozen=True)
class Spelling:
    """The bytes of all ids, end to end; an id that spells nothing has size -1."""

    data: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(table: list[bytes | None]) -> Spelling:
        sizes = np.array([-1 if b is None else len(b) for b in table], dtype=np.int64)
        full = np.maximum(sizes, 0)
        return Spelling(np.frombuffer(b"".join(b or b"" for b in table), dtype=np.uint8), np.cumsum(full) - full, sizes)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[runs(self.begins[ids], self.sizes[ids])]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves,
    the others for the letters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """The two tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        table: list[bytes | None] = [None] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else None
        self.spelled_a = Spelling.of(table)
        p, pieces = self.b, []
        for i in range(p.get_piece_size()):
            if p.is_byte(i):
                pieces.append(bytes([int(p.id_to_piece(i)[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i):
                pieces.append(None)
            else:
                pieces.append(p.id_to_piece(i).replace("▁", " ").encode())
        self.spelled_b = Spelling.of(pieces)
        self.width, self.space = len(pieces), [p.piece_to_id("▁")]
        if len(table) * len(pieces) > 1 << 40:
            raise ValueError("vocabularies of more than 2^40 id pairs")
        self.kind = "<u4" if len(table) * len(pieces) <= 1 << 32 else "<u8"

    def ids_a(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts end to end, and how many each part has."""
        return _laid([x.ids for x in self.a.encode_batch_fast(parts, add_special_tokens=False)])

    def ids_b(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same; each part begins with the space that the vocabulary adds."""
        ids = self.b.encode([t[1:] for t in parts], num_threads=1)
        return _laid([self.space if t == " " else x for t, x in zip(parts, ids, strict=True)])  # an empty text gets no space


def _laid(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    return np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(sizes.sum())), sizes


@lru_cache(maxsize=2)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def spells(spelling: Spelling, ids: np.ndarray, counts: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """For each part whether its ids spell it."""
    owner, sizes = np.repeat(np.arange(len(parts)), counts), spelling.sizes[ids]
    want = np.array([len(p) for p in parts], dtype=np.int64)
    right = np.bincount(owner, weights=sizes, minlength=len(parts)).astype(np.int64) == want
    right &= np.bincount(owner, weights=sizes < 0, minlength=len(parts)) == 0
    same = spelling.spell(ids[right[owner]]) == np.frombuffer(b"".join(p for p, ok in zip(parts, right, strict=True) if ok), dtype=np.uint8)
    wrong = np.repeat(np.flatnonzero(right), want[right])[~same]
    right[wrong] = False
    return right


# -- fragments


@dataclass(frozen=True)
class Tokens:
    """Neighbouring tokens of both vocabularies, with the byte at which each ends in its text."""

    end_a: np.ndarray
    id_a: np.ndarray
    end_b: np.ndarray
    id_b: np.ndarray

    def __len__(self) -> int:
        return len(self.end_a) + len(self.end_b)

    def __add__(self, more: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(self.columns(), more.columns(), strict=True)))

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.end_a, self.id_a, self.end_b, self.id_b

    def cut(self, ends: list[int]) -> list[Tokens]:
        """The tokens up to each of the ends, and those after the last."""
        a = [0, *np.searchsorted(self.end_a, ends, side="right").tolist(), len(self.end_a)]
        b = [0, *np.searchsorted(self.end_b, ends, side="right").tolist(), len(self.end_b)]
        return [Tokens(self.end_a[i:j], self.id_a[i:j], self.end_b[k:m], self.id_b[k:m]) for i, j, k, m in zip(a[:-1], a[1:], b[:-1], b[1:], strict=True)]

    def common(self) -> np.ndarray:
        return np.intersect1d(self.end_a, self.end_b, assume_unique=True)

    def pack(self) -> bytes:
        return np.concatenate(([len(self.end_a)], *self.columns())).astype("<i8").tobytes()

    @staticmethod
    def unpack(data: bytes) -> Tokens:
        x = np.frombuffer(data, dtype="<i8")
        n = int(x[0])
        m = (len(x) - 1) // 2 - n
        return Tokens(*np.split(x[1:], [n, 2 * n, 2 * n + m]))


NONE = Tokens(*(np.zeros(0, dtype=np.int64) for _ in range(4)))


@dataclass(frozen=True)
class Fragment:
    """A part of a text: the tokens up to its first common end, and those after the last. Without a
    common end all its tokens are in the prefix."""

    prefix: Tokens
    suffix: Tokens = NONE
    closed: bool = False


def fragment(tokens: Tokens, closes: bool = False) -> tuple[Fragment, Tokens]:
    """The fragment of some tokens, and its closed groups."""
    ends = tokens.common()
    if not len(ends):
        return Fragment(tokens), NONE
    prefix, groups, suffix = tokens.cut([int(ends[0]), int(ends[-1])])
    return Fragment(prefix, suffix, True), groups


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, Tokens]:
    """The fragment of two neighbouring parts, and the groups that close between them."""
    if not left.closed:
        whole, groups = fragment(left.prefix + right.prefix)
        # what follows the right one's first common end is its suffix
        return (Fragment(whole.prefix, right.suffix, True) if right.closed else whole), groups
    between = left.suffix + right.prefix
    if right.closed:
        return Fragment(left.prefix, right.suffix, True), between
    ends = between.common()
    groups, suffix = between.cut([int(ends[-1])]) if len(ends) else (NONE, between)
    return Fragment(left.prefix, suffix, True), groups


# -- what groups give


def described(tokens: Tokens, width: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of closed groups: the text of each, their ends, and the links' ends and pairs of ids."""
    ends = tokens.common()
    edge_a = np.searchsorted(tokens.end_a, ends, side="right").tolist()
    edge_b = np.searchsorted(tokens.end_b, ends, side="right").tolist()
    name_a, name_b = list(map(str, tokens.id_a.tolist())), list(map(str, tokens.id_b.tolist()))
    texts, i, k = [], 0, 0
    for j, m in zip(edge_a, edge_b, strict=True):
        texts.append(f"{','.join(name_a[i:j])}|{','.join(name_b[k:m])}")
        i, k = j, m
    # between two neighbouring ends lie the bytes that one A and one B token share
    met = np.union1d(tokens.end_a, tokens.end_b)
    pairs = tokens.id_a[np.searchsorted(tokens.end_a, met)] * width + tokens.id_b[np.searchsorted(tokens.end_b, met)]
    return texts, ends, met, pairs


def pack_pairs(pairs: np.ndarray, times: np.ndarray, kind: str) -> tuple[bytes, bytes]:
    """Sorted pairs by their distances, and how often each occurs."""
    return np.diff(pairs, prepend=0).astype(kind).tobytes(), times.astype("<u4").tobytes()


def unpack_pairs(pairs: pd.Series, times: pd.Series, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, times) of some rows."""
    n = np.array([len(t) // 4 for t in times], dtype=np.int64)
    apart = np.cumsum(np.frombuffer(b"".join(pairs), dtype=kind).astype(np.int64))
    total = np.concatenate(([0], apart))[np.cumsum(n) - n]
    return np.repeat(np.arange(len(n)), n), apart - np.repeat(total, n), np.frombuffer(b"".join(times), dtype="<u4").astype(np.int64)


class _Grown:
    """An array that grows at its end."""

    def __init__(self):
        self.data, self.size = np.zeros(1 << 12, dtype=np.int64), 0

    def extend(self, values: np.ndarray) -> None:
        while self.size + len(values) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        self.data[self.size : self.size + len(values)] = values
        self.size += len(values)


class Units:
    """Units met so far: their groups as text, the counts of tokens, groups and links, the pairs linked."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = [_Grown() for _ in range(4)]
        self.wrong, self.begins, self.pairs = _Grown(), _Grown(), _Grown()

    def learn(self, units: list[str]) -> None:
        p = self.pair
        parts = [u.encode() for u in units]
        (id_a, n_a), (id_b, n_b) = p.ids_a(units), p.ids_b(units)
        right = spells(p.spelled_a, id_a, n_a, parts) & spells(p.spelled_b, id_b, n_b, parts)
        id_a, id_b = id_a[np.repeat(right, n_a)], id_b[np.repeat(right, n_b)]
        n_a, n_b = np.where(right, n_a, 0), np.where(right, n_b, 0)
        tokens = Tokens(np.cumsum(p.spelled_a.sizes[id_a]), id_a, np.cumsum(p.spelled_b.sizes[id_b]), id_b)
        texts, ends, met, pairs = described(tokens, p.width)
        last = np.cumsum([len(b) if ok else 0 for b, ok in zip(parts, right, strict=True)])
        edge = np.concatenate(([0], np.searchsorted(ends, last, side="right")))
        links = np.concatenate(([0], np.searchsorted(met, last, side="right")))
        for k, u in enumerate(units):
            self.known[u] = len(self.groups)
            self.groups.append(";".join(texts[edge[k] : edge[k + 1]]))
        for column, values in zip(self.counts, (n_a, n_b, np.diff(edge), np.diff(links)), strict=True):
            column.extend(values)
        self.wrong.extend(~right)
        self.begins.extend(links[:-1] + self.pairs.size)
        self.pairs.extend(pairs)

    def align(self, texts: list[str | None]) -> pd.DataFrame:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of whole texts."""
        cut = [_CUT_A.split(" " + t) if t else [] for t in texts]
        if len(self.known) > _KEPT:
            self.clear()
        fresh = list({u for own in cut for u in own if u not in self.known})
        for lo in range(0, len(fresh), 20_000):
            self.learn(fresh[lo : lo + 20_000])
        size = np.array([len(own) for own in cut], dtype=np.int64)
        unit = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(size.sum()))
        owner = np.repeat(np.arange(len(texts)), size)
        wrong = np.bincount(owner, weights=self.wrong.data[unit], minlength=len(texts)) > 0
        unit, owner = unit[~wrong[owner]], owner[~wrong[owner]]
        out = {}
        for name, column in zip(("n_a", "n_b", "n_groups", "n_links"), self.counts, strict=True):
            out[name] = np.bincount(owner, weights=column.data[unit], minlength=len(texts)).astype(np.int64)
        edge = np.searchsorted(owner, np.arange(len(texts) + 1))
        number, name = unit.tolist(), self.groups
        out["groups_sha256"] = [
            hashlib.sha256(";".join([name[u] for u in number[a:b]]).encode()).hexdigest() if b > a else ""
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)
        ]
        n = self.counts[3].data[unit]
        key = (np.repeat(owner, n) << 40) | self.pairs.data[runs(self.begins.data[unit], n)]
        key, times = np.unique(key, return_counts=True)
        at = np.searchsorted(key >> 40, np.arange(len(texts) + 1))
        key &= (1 << 40) - 1
        packed = [pack_pairs(key[a:b], times[a:b], self.pair.kind) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pd.DataFrame(out | {"pairs": [x for x, _ in packed], "times": [y for _, y in packed]})


@lru_cache(maxsize=1)
def _units(path_a: str, path_b: str) -> Units:
    return Units(_pair(path_a, path_b))


# -- long documents


def byte_ranges(text: str, size: int) -> Iterator[int]:
    """Places in a text before which each further `size` bytes end, short of its end."""
    at = 0
    while True:
        at += len(text[at : at + size].encode()[:size].decode("utf-8", "ignore"))
        if at >= len(text):
            return
        yield at


def parts_of(text: str, chunk: int) -> Iterator[tuple[int, str, int, str, int]]:
    """(number, part for A, its first byte, part for B, its first byte) of a text with its space."""
    at, byte = [0, 0], [0, 0]
    number = 0
    for aim in chain(byte_ranges(text, max(4, chunk)), [len(text)]):
        row = [number]
        for v, pattern in enumerate((_CUT_A, _CUT_B)):
            to = at[v]
            if aim == len(text):
                to = aim
            elif aim > to:
                found = pattern.search(text, aim)
                to = found.start() if found else len(text)
            part = text[at[v] : to]
            row += [part, byte[v]]
            at[v], byte[v] = to, byte[v] + len(part.encode())
        yield tuple(row)
        number += 1


_PIECE = "row long, at long, ok boolean, closed boolean, prefix binary, suffix binary, place long, n_a long, n_b long, n_groups long, n_links long, text string, pairs binary, times binary"
_FRAGMENT = ["row", "at", "ok", "closed", "prefix", "suffix"]
_SUMS = ["n_a", "n_b", "n_groups", "n_links"]


def _fragment_row(row: int, at: int, f: Fragment, ok: bool) -> dict:
    return {"row": row, "at": at, "ok": ok, "closed": f.closed, "prefix": f.prefix.pack(), "suffix": f.suffix.pack()}


def _piece_row(row: int, tokens: Tokens, pair: Pair) -> dict:
    texts, ends, met, links = described(tokens, pair.width)
    found, times = np.unique(links, return_counts=True)
    pairs, times = pack_pairs(found, times, pair.kind)
    return {
        "row": row, "place": int(ends[-1]), "n_a": len(tokens.end_a), "n_b": len(tokens.end_b), "n_groups": len(ends), "n_links": len(met),
        "text": ";".join(texts), "pairs": pairs, "times": times,
    }


_TYPES = {"long": "Int64", "boolean": "boolean"}


def _frame(rows: list[dict]) -> pd.DataFrame:
    """Rows with all columns of _PIECE; numbers keep all digits beside nulls."""
    fields = [f.rsplit(" ", 1) for f in _PIECE.split(", ")]
    return pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype=_TYPES.get(kind, object)) for name, kind in fields})


def chunk_table(docs: DataFrame, chunk: int) -> DataFrame:
    """(row, id, at, part_a, byte_a, part_b, byte_b) of (row, id, text) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, i, t in zip(pdf["row"], pdf["id"], pdf["text"], strict=True):
                for number, a, byte_a, b, byte_b in parts_of(" " + t, chunk):
                    yield pd.DataFrame({"row": [row], "id": [i], "at": [number], "part_a": [a], "byte_a": [byte_a], "part_b": [b], "byte_b": [byte_b]})

    return docs.mapInPandas(run, "row long, id string, at long, part_a string, byte_a long, part_b string, byte_b long")


def chunk_fragments(chunks: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A fragment and the closed groups of each chunk, as rows of _PIECE."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = _pair(path_a, path_b)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                (id_a, n_a), (id_b, n_b) = p.ids_a([r.part_a]), p.ids_b([r.part_b])
                ok = bool(spells(p.spelled_a, id_a, n_a, [r.part_a.encode()])[0] and spells(p.spelled_b, id_b, n_b, [r.part_b.encode()])[0])
                out = [_fragment_row(r.row, r.at, Fragment(NONE), False)]
                if ok:
                    tokens = Tokens(np.cumsum(p.spelled_a.sizes[id_a]) + r.byte_a, id_a, np.cumsum(p.spelled_b.sizes[id_b]) + r.byte_b, id_b)
                    f, groups = fragment(tokens)
                    out = [_fragment_row(r.row, r.at, f, True), *([_piece_row(r.row, groups, p)] if len(groups) else [])]
                yield _frame(out)

    return chunks.mapInPandas(run, _PIECE)


def composed(fragments: DataFrame, fan: int, path_a: str, path_b: str, last: bool) -> DataFrame:
    """Every `fan` neighbours composed, as rows of _PIECE. At the last step a text's beginning closes
    its prefix as well."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = _pair(path_a, path_b)
        for group in _by_group(batches, ["row", "parent"]):
            row, ok, out = int(group["row"].iloc[0]), bool(group["ok"].all()), []
            whole = Fragment(NONE)
            for prefix, suffix, closed in zip(group["prefix"], group["suffix"], group["closed"], strict=True):
                whole, groups = compose(whole, Fragment(Tokens.unpack(prefix), Tokens.unpack(suffix), bool(closed)))
                if len(groups) and ok:
                    out.append(_piece_row(row, groups, p))
            if last and ok:
                out.append(_piece_row(row, whole.prefix, p))
            yield _frame([_fragment_row(row, int(group["parent"].iloc[0]), whole, ok), *out])

    rows = fragments.select(*_FRAGMENT, F.expr(f"at div {fan}L").alias("parent"))
    return rows.repartition("row", "parent").sortWithinPartitions("row", "parent", "at").mapInPandas(run, _PIECE)


def _digests(pieces: DataFrame) -> DataFrame:
    """(row, groups_sha256): pieces of a row stream by in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for pdf in batches:
            done = []
            for row, text in zip(pdf["row"], pdf["text"], strict=True):
                if row != now:
                    done += [] if now is None else [(now, digest.hexdigest())]
                    now, digest = row, hashlib.sha256(text.encode())
                else:
                    digest.update(b";" + text.encode())
            yield pd.DataFrame(done, columns=["row", "groups_sha256"])
        if now is not None:
            yield pd.DataFrame({"row": [now], "groups_sha256": [digest.hexdigest()]})

    return pieces.select("row", "place", "text").repartition("row").sortWithinPartitions("row", "place").mapInPandas(run, "row long, groups_sha256 string")


# -- counts of pairs


def _document_counts(held: DataFrame, kind: str) -> DataFrame:
    """(pair, n) of rows that are a document each, not yet summed over tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, n = [], []
        for pdf in batches:
            found, count = np.unique(unpack_pairs(pdf["pairs"], pdf["times"], kind)[1], return_counts=True)
            pairs, n = [*pairs, found], [*n, count]
            if len(pairs) >= 8:
                pairs, n = ([x] for x in _summed(pairs, n))
                if len(pairs[0]) > _COUNTED:
                    yield pd.DataFrame({"pair": pairs[0], "n": n[0]})
                    pairs, n = [], []
        if pairs:
            yield pd.DataFrame(dict(zip(("pair", "n"), _summed(pairs, n), strict=True)))

    return held.select("pairs", "times").mapInPandas(run, "pair long, n long")


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), dtype=np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return found, total


def _unpacked(held: DataFrame, kind: str) -> DataFrame:
    """(row, pair, times) of rows with packed pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            owner, pair, times = unpack_pairs(pdf["pairs"], pdf["times"], kind)
            row = pdf["row"].to_numpy()[owner]
            for lo in range(0, len(row), 500_000):
                yield pd.DataFrame({"row": row[lo : lo + 500_000], "pair": pair[lo : lo + 500_000], "times": times[lo : lo + 500_000]})

    return held.select("row", "pairs", "times").mapInPandas(run, "row long, pair long, times long")


def pair_counts(short: DataFrame, pieces: DataFrame, pair: Pair) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked, and whether no pair of its A id has more."""
    apart = _unpacked(pieces, pair.kind).select("row", "pair").distinct().select("pair", F.lit(1).cast("long").alias("n"))
    counts = _document_counts(short, pair.kind).unionByName(apart).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = settle(counts.withColumn("a", F.expr(f"pair div {pair.width}L")), "counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(held: DataFrame, counts: DataFrame, kind: str, sent) -> DataFrame:
    """(row, n_best, count_sum) of rows with packed pairs; a row may come in several parts. `sent` has
    the sorted pairs, their counts and best marks, or is None, in which case `counts` is joined."""
    if sent is None:
        met = _unpacked(held, kind).join(counts, "pair")
        return met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, n, best = sent.value
        for pdf in batches:
            owner, pair, times = unpack_pairs(pdf["pairs"], pdf["times"], kind)
            at = np.searchsorted(pairs, pair)
            sums = [np.zeros(len(pdf), dtype=np.int64) for _ in range(2)]
            np.add.at(sums[0], owner, best[at] * times)
            np.add.at(sums[1], owner, n[at] * times)
            yield pd.DataFrame({"row": pdf["row"], "n_best": sums[0], "count_sum": sums[1]})

    return held.select("row", "pairs", "times").mapInPandas(run, "row long, n_best long, count_sum long")


def short_alignment(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(id, counts, digest, pairs, times) of each (id, text) row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = _units(path_a, path_b)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in by_bytes(texts, 1_000_000):
                yield units.align(texts[lo:hi]).assign(id=pdf["id"].iloc[lo:hi].to_numpy())

    return rows.mapInPandas(run, "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, id string")


def long_alignment(rows: DataFrame, path_a: str, path_b: str, chunk: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """(row, id, counts, digest) of long documents, and their pieces (row, ..., pairs, times)."""
    chunks = settle(chunk_table(rows.withColumn("row", F.monotonically_increasing_id()), chunk).repartition("row", "at"), "chunks")
    step = settle(chunk_fragments(chunks, path_a, path_b), "fragments")
    steps, top = [step], int(chunks.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0])
    while True:
        step = settle(composed(step.filter("prefix is not null"), fan, path_a, path_b, top < fan), "fragments")
        steps.append(step)
        if top < fan:
            break
        top //= fan
    names = chunks.filter("at = 0").select("row", "id")
    good = step.filter("prefix is not null and ok").select("row")
    pieces = steps[0]
    for more in steps[1:]:
        pieces = pieces.unionByName(more)
    pieces = pieces.filter("prefix is null").join(good, "row", "left_semi").select("row", "place", *_SUMS, "text", "pairs", "times")
    pieces = settle(pieces, "pieces")
    sums = pieces.groupBy("row").agg(*(F.sum(c).alias(c) for c in _SUMS)).join(_digests(pieces), "row")
    whole = settle(names.join(sums, "row", "left"), "long")
    discard(chunks, *steps)
    return whole, pieces


def alignments(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = 65_536,
    fan: int = 32,
    kept_pairs: int = 4_000_000,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row."""
    spark, pair = docs.sparkSession, _pair(path_a, path_b)
    rows = docs.select(carried(id_col).alias("id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    short = short_alignment(rows.filter(~is_long), path_a, path_b).withColumn("row", F.monotonically_increasing_id())
    short = settle(short, "short")
    whole, pieces = long_alignment(rows.filter(is_long), path_a, path_b, chunk, fan)
    counts = settle(pair_counts(short, pieces, pair), "pair_counts")
    sent = None
    if counts.count() <= kept_pairs:
        table = counts.orderBy("pair").toArrow()
        sent = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))
    columns = ["row", "id", *_SUMS, "groups_sha256"]
    out = short.select(*columns).join(scored(short, counts, pair.kind, sent), "row", "left")
    long_score = scored(pieces, counts, pair.kind, sent).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = out.unionByName(whole.select(*columns).join(long_score, "row", "left"))
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*_SUMS, "n_best", "count_sum")),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
