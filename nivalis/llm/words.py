"""Vectorised word hashing shared by the corpus operators.

A batch of texts becomes one byte buffer.  Word boundaries come from a table of separator
bytes, and every word gets a 64-bit polynomial hash read off a prefix sum, so the cost is a
few array passes per byte and no Python object per word.  Bytes of multi-byte UTF-8
characters are never separators, hence byte classes equal the character classes used here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Words `[^\x20\x09-\x0D]+`.
SPACE_SEPARATORS = np.zeros(256, dtype=bool)
SPACE_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, to be used after lower-casing A-Z.
ALNUM_SEPARATORS = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM_SEPARATORS[_lo : _hi + 1] = True

SAME_CASE = np.arange(256, dtype=np.uint8)
LOWER_AZ = SAME_CASE.copy()
LOWER_AZ[0x41:0x5B] += 32

#: Text bytes hashed at once; bounds the scratch arrays of a task.
PIECE_BYTES = 2_000_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        full[0] = 1
        have = _powers[base] = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def window_hashes(items: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` consecutive values; empty when there are fewer."""
    if len(items) < size:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(items) + 1, dtype=np.uint64)
    np.cumsum(items * _power(_BASE, len(items)), out=total[1:])
    n = len(items) - size + 1
    return mix((total[size:] - total[:n]) * _power(_INVERSE, n) + np.uint64(size))


def _spans(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hash_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODES[data] * _power(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Hashes and byte spans of all words of a batch of documents, laid end to end."""

    def __init__(self, hashes, starts, ends, offsets, data):
        self.hashes, self.starts, self.ends, self.offsets, self.data = hashes, starts, ends, offsets, data

    def doc(self, k: int) -> slice:
        return slice(int(self.offsets[k]), int(self.offsets[k + 1]))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def split_words(texts: list[str | None], separators=SPACE_SEPARATORS, case=SAME_CASE) -> Words:
    """Words of each text; a null text has none. Words of one text stay together at
    `offsets[k]:offsets[k + 1]`."""
    encoded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter((len(b) for b in encoded), dtype=np.int64, count=len(encoded))
    begins = np.zeros(len(encoded) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=begins[1:])
    data = case[np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)] if encoded else np.zeros(0, np.uint8)
    starts, ends = _spans(data, separators)
    offsets = np.searchsorted(starts, begins)
    hashes = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):  # pieces end between words; a longer word makes a longer piece
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE_BYTES, side="right")))
        a = starts[lo]
        hashes[lo:hi] = _hash_piece(data[a : ends[hi - 1]], starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return Words(hashes, starts, ends, offsets, data)


def prefix_hashes(words: Words, size: int) -> np.ndarray:
    """Hash of the first `size` bytes of every word that has more; 0 for the others."""
    out = np.zeros(len(words.starts), dtype=np.uint64)
    long = words.ends - words.starts > size
    at, powers = words.starts[long], _power(_BASE, size)
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        total += _CODES[words.data[at + k]] * powers[k]
    out[long] = mix(total + np.uint64(size << 40))
    return out


def by_bytes(texts: list[str | None], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose texts hold about `limit` characters each."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += 1 + (len(t) if t else 0)
        if size >= limit:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


class HashTable:
    """Membership and position of 64-bit keys in a fixed set of distinct keys. Only the keys are sent
    along; the slots are made where the table is used. Keys that share a slot with an earlier one are
    found by binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys)
        self._deal()

    def _deal(self) -> None:
        bits = min(24, max(10, int(np.ceil(np.log2(max(1, len(self.keys)) * 4)))))
        self.mask = np.uint64((1 << bits) - 1)
        slot = (self.keys & self.mask).astype(np.int64)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.slots[slot[::-1]] = np.arange(len(slot) - 1, -1, -1, dtype=np.int32)
        late = np.flatnonzero(self.slots[slot] != np.arange(len(slot)))
        self.late = late[np.argsort(self.keys[late], kind="stable")]
        self.late_keys = self.keys[self.late]
        self.crowded = np.zeros(1 << bits, dtype=bool)
        self.crowded[slot[late]] = True

    def __getstate__(self):
        return self.keys

    def __setstate__(self, keys):
        self.keys = keys
        self._deal()

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index into the given keys, or -1."""
        if not len(self.keys) or not len(values):
            return np.full(len(values), -1, dtype=np.int64)
        slot = (values & self.mask).astype(np.int64)
        out = self.slots[slot].astype(np.int64)
        out[self.keys[out] != values] = -1  # a free slot reads the last key, which is compared as well
        if len(self.late):
            open_ = np.flatnonzero((out < 0) & self.crowded[slot])
            at = np.searchsorted(self.late_keys, values[open_])
            at[at == len(self.late_keys)] = 0
            hit = self.late_keys[at] == values[open_]
            out[open_[hit]] = self.late[at[hit]]
        return out


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
