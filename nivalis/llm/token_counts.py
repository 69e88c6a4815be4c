"""Exact token counts with a byte-level BPE vocabulary, bounded in memory for huge documents.

A document of more than `chunk` characters is encoded in overlapping chunks, with offsets.  Two
neighbouring chunks are spliced at a common boundary that is proven stable: a place inside the
overlap where both encodings begin a pre-token that is not the first of its chunk.  The
pre-tokenizer scans from left to right and remembers nothing, so from such a place on both scans
must agree, and by induction from the start of the text every counted token is one of the whole
text.  Places within `_GUARD` characters of a chunk's end are not trusted, since the scan looks a
few characters ahead and special strings may be cut there.  Where the overlap holds no common
boundary (a long run without one) it is doubled, until it reaches the last splice; from there the
chunk itself grows.

Shorter documents are one chunk.  Their words repeat a lot, so a task keeps the counts of text
units already encoded; units are cut before a single space between two visible characters, where
a pre-token always begins.

Defined cases: null and empty texts have 0 bytes and 0 tokens.  Every input row gives one output
row, repeated and null ids too; an empty table gives an empty table.  Special strings in a text count as the library counts them by default.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nivalis.llm.tables import carried

#: Characters at a chunk's end where boundaries are not trusted.
_GUARD = 64
#: Units whose counts a task keeps.
_KEPT = 400_000
_UNIT = re.compile(r"(?<=[\w.,;:!?|%&*$#)-])(?= \w)")

Encoded = tuple[np.ndarray, np.ndarray]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_with_starts(tokenizer) -> Callable[[str], Encoded]:
    """A function from text to (start of each token, whether it begins a pre-token)."""

    def encode(text: str) -> Encoded:
        found = tokenizer.encode(text, add_special_tokens=False)
        starts = np.fromiter((a for a, _ in found.offsets), dtype=np.int64, count=len(found.ids))
        # special tokens have no word number; each stands alone
        words = np.fromiter((-1 if w is None else w for w in found.word_ids), dtype=np.int64, count=len(found.ids))
        first = np.ones(len(starts), dtype=bool)
        first[1:] = (words[1:] != words[:-1]) | (words[1:] == -1)
        return starts, first

    return encode


def count_in_chunks(text: str, encode: Callable[[str], Encoded], chunk: int, overlap: int) -> int:
    """Tokens of the whole text, of which `encode` sees only overlapping chunks."""
    total, splice, begin, size = 0, 0, 0, chunk
    starts, first = encode(text[:size])
    while begin + size < len(text):
        end, back = begin + size, overlap
        while True:
            at = max(splice, end - back)
            grown = chunk if at > splice else 2 * size
            more, more_first = encode(text[at : at + grown])
            if at == splice:  # a proven boundary itself
                found = splice
                break
            mine = starts[first] + begin
            theirs = (more[more_first] + at)[1:]
            common = np.intersect1d(mine[(mine > splice) & (mine < end - _GUARD)], theirs)
            if len(common):
                found = int(common[len(common) // 2])
                break
            back *= 2
        total += int(((starts + begin >= splice) & (starts + begin < found)).sum())
        splice, begin, size, starts, first = found, at, grown, more, more_first
    return total + int((starts + begin >= splice).sum())


def _counter(path: str, chunk: int, overlap: int) -> Callable[[list[str]], list[int]]:
    tokenizer = _tokenizer(path)
    encode = encode_with_starts(tokenizer)
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        units = [_UNIT.split(t) if len(t) <= chunk else None for t in texts]
        if len(known) > _KEPT:
            known.clear()
        fresh = list({u for own in units if own for u in own if u not in known})
        for lo in range(0, len(fresh), 20_000):
            some = fresh[lo : lo + 20_000]
            known.update(zip(some, map(len, tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        return [
            count_in_chunks(t, encode, chunk, overlap) if own is None else sum(map(known.__getitem__, own))
            for t, own in zip(texts, units, strict=True)
        ]

    return count


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = 32_768,
    overlap: int = 1_024,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; no shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(path, chunk, overlap)
        for pdf in batches:
            n = []
            for lo in range(0, len(pdf), 500):
                n += counter([t or "" for t in pdf["text"].iloc[lo : lo + 500]])
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": pdf["n_bytes"], "n_tokens": n, "over_limit": [x > limit for x in n]})

    rows = docs.select(
        carried(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    out = rows.mapInPandas(count, "id string, n_bytes long, n_tokens long, over_limit boolean")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_tokens", "over_limit")
