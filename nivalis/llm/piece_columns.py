"""The lattice of substrings as numpy columns, for the units that a task meets.

Code points of many units are laid end to end.  For every size up to the longest piece, the
substrings of that size are hashed and looked up in the piece table, which gives a table of edges
(place x size).  The fold replays merges for all units at once: in each round every unit merges its
best adjacent pair, the leftmost among equals, until no unit has one.
"""

from __future__ import annotations

import numpy as np

from nivalis.llm.words import HashTable, mix

MARK = 0x2581
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32((1 << 31) - 1)
_PLACES = 500_000  # places of a lattice at once; bounds the scratch arrays of a task


def runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all ranges `begins[k] : begins[k] + sizes[k]`, one after another."""
    to = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(begins - to, sizes)


class Pieces:
    """The piece table: hash of a piece to its place in order of rank."""

    def __init__(self, pieces: list[str], ids: np.ndarray, ranks: np.ndarray, first_byte: int):
        order = np.argsort(ranks, kind="stable")
        self.ids, self.ranks = ids[order].astype(np.int32), np.append(ranks[order], _NONE).astype(np.int64)
        codes = [np.frombuffer(pieces[k].encode("utf-32-le"), dtype=np.uint32) for k in order]
        self.longest, self.first_byte = max(map(len, codes)), first_byte
        self.table = HashTable(np.array([_spelled(c) for c in codes], dtype=np.uint64))


def _letters(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + _BASE)


def _spelled(codes: np.ndarray) -> np.uint64:
    h = np.zeros(1, dtype=np.uint64)
    for x in _letters(codes):
        h = h * _BASE + x
    return h[0]


def edges(codes: np.ndarray, remain: np.ndarray, pieces: Pieces) -> np.ndarray:
    """For each place and size (less one) the piece there, by rank, or `_NONE`; `remain` are the
    characters from a place to its unit's end."""
    out = np.full((len(codes), pieces.longest), _NONE, dtype=np.int32)
    letters = _letters(codes)
    at, h = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
    for size in range(1, pieces.longest + 1):
        has = remain[at] >= size
        at, h = at[has], h[has]
        if not len(at):
            break
        h = h * _BASE + letters[at + (size - 1)]
        found = pieces.table.find(h)
        hit = found >= 0
        out[at[hit], size - 1] = found[hit]
    return out


def fold_merges(lattice: np.ndarray, owner: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Begins of the segments that stay; `owner` is the unit of each place, ascending."""
    longest = lattice.shape[1]
    begin, done = np.arange(len(owner)), [np.zeros(0, dtype=np.int64)]
    unit, end = owner, begin + 1
    while len(begin):
        size = np.zeros(len(begin), dtype=np.int64)
        same = unit[1:] == unit[:-1]
        size[:-1] = np.where(same, end[1:] - begin[:-1], 0)
        able = np.flatnonzero((size > 1) & (size <= longest))
        key = np.full(len(begin), int(_NONE) << 32, dtype=np.int64)
        key[able] = ranks[np.minimum(lattice[begin[able], size[able] - 1], len(ranks) - 1)] << 32
        key |= np.arange(len(begin))
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        best = np.minimum.reduceat(key, first)
        live = (best >> 32) < int(_NONE)
        lengths = np.diff(np.append(first, len(begin)))
        keep = np.repeat(live, lengths)
        done.append(begin[~keep])
        left = best[live] & 0xFFFFFFFF
        end[left] = end[left + 1]
        keep[left + 1] = False
        begin, end, unit = begin[keep], end[keep], unit[keep]
    return np.sort(np.concatenate(done))


def _utf8(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points, and how many each has."""
    data = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return np.frombuffer(data, dtype=np.uint8), 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def encode(codes: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units laid end to end, and how many each unit has. No unit may be empty."""
    ids, counts, lo, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0, np.cumsum(sizes)
    while lo < len(sizes):
        a = int(ends[lo] - sizes[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, a + _PLACES, side="right")))
        some, n = codes[a : ends[hi - 1]], sizes[lo:hi]
        owner = np.repeat(np.arange(hi - lo), n)
        lattice = edges(some, np.repeat(np.cumsum(n), n) - np.arange(len(some)), pieces)
        begin = fold_merges(lattice, owner, pieces.ranks)
        found = lattice[begin, np.diff(np.append(begin, len(some))) - 1]
        plain = found == _NONE  # a character without a piece becomes its bytes' pieces
        spelled, width = _utf8(some[begin[plain]])
        takes = np.ones(len(begin), dtype=np.int64)
        takes[plain] = width
        made = np.empty(int(takes.sum()), dtype=np.int32)
        bytewise = np.repeat(plain, takes)
        made[~bytewise] = pieces.ids[found[~plain]]
        made[bytewise] = spelled.astype(np.int32) + pieces.first_byte
        ids.append(made)
        counts.append(np.bincount(owner[begin], weights=takes, minlength=hi - lo).astype(np.int64))
        lo = hi
    return np.concatenate(ids), np.concatenate(counts)


class Units:
    """The units of texts laid end to end: code points, begins, sizes and hashes; `offsets` has each text's first unit."""

    def __init__(self, texts: list[str]):
        whole = "".join(" " + t if t else "" for t in texts)  # one mark comes before every text
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        codes[codes == 0x20] = MARK
        self.codes = codes
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        begins = np.concatenate(([0], np.cumsum(lengths)))
        mark = codes == MARK
        opens = mark.copy()
        opens[1:] &= ~mark[:-1]
        opens[begins[:-1][lengths > 0]] = True
        self.begins = np.flatnonzero(opens)
        self.sizes = np.diff(np.append(self.begins, len(codes)))
        self.offsets = np.searchsorted(self.begins, begins)
        if not len(codes):
            self.hashes = np.zeros(0, dtype=np.uint64)
            return
        place = np.arange(len(codes)) - np.repeat(self.begins, self.sizes)
        powers = np.full(int(self.sizes.max()), _BASE, dtype=np.uint64)
        powers[0] = 1
        terms = _letters(codes) * np.cumprod(powers, dtype=np.uint64)[place]
        self.hashes = mix(np.add.reduceat(terms, self.begins) + self.sizes.astype(np.uint64))
