"""Language identification by rank-order n-gram profiles.

Every language gets a profile: its `top` most frequent letter n-grams (n = 1..3, words padded
with `_`) in rank order.  A document's own most frequent n-grams are compared with each profile
by the out-of-place distance: the sum of rank differences, an absent n-gram counting `top`.
The nearest profile wins; equal distances go to the language first in the alphabet.

Defined cases: a text that is null, empty or has no letter gets `und` with score 0; without any
profile (empty training table) every text gets `und`.  Rows with a null language or text teach
nothing.  Repeated rows count repeatedly.  Only the named columns are read, so any other column
of the input is left alone and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from nivalis.llm.tables import remainder
from nivalis.llm.words import by_bytes, letter_table

UNDETERMINED = "und"
#: Letters of a code point fit 21 bits, so three of them fit one long.
_BITS = 21
_PAD = 0x5F
#: Distinct n-grams that a task keeps before it hands counts on.
_HELD = 2_000_000


def _code_points(text: str | None) -> np.ndarray:
    """Lower-cased letters with one pad at both ends and wherever other characters were."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.where(letter_table()[raw], raw, _PAD)
    padded = np.concatenate(([_PAD], letters, [_PAD])).astype(np.int64)
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != _PAD) | (padded[:-1] != _PAD)
    return padded[keep]


def _ngrams(points: np.ndarray, codes: np.ndarray, base: int) -> np.ndarray:
    """Keys of all 1-, 2- and 3-grams that hold a letter; `codes` are positive and below `base`,
    and a shorter n-gram sorts before those that extend it. Two pads in a row are the border of two
    texts, over which no n-gram reaches."""
    letter = points != _PAD
    whole = letter[:-1] | letter[1:]
    one = (codes * (base * base))[letter]
    two = codes[:-1] * (base * base) + codes[1:] * base
    three = two[:-1] + codes[2:]
    return np.concatenate((one, two[whole], three[whole[:-1] & whole[1:]]))


def _wide(points: np.ndarray) -> np.ndarray:
    return _ngrams(points, points, 1 << _BITS)


def ngram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, ngram, n) over all rows; each task adds up its own rows before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, parts in held.items():
                keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pd.DataFrame({"lang": lang, "ngram": keys, "n": n})
            held.clear()

        for pdf in batches:
            for lang, group in pdf.groupby("lang"):
                texts = group["text"].tolist()
                for lo, hi in by_bytes(texts):
                    points = np.concatenate([_code_points(t) for t in texts[lo:hi]])
                    alphabet, dense = np.unique(points, return_inverse=True)
                    base = len(alphabet) + 1
                    keys = _ngrams(points, dense.astype(np.int64) + 1, base)
                    keys, n = np.unique(keys.astype(np.int32) if base**3 < 2**31 else keys, return_counts=True)
                    keys = keys.astype(np.int64)
                    wide = np.concatenate(([0], alphabet))
                    a, b, c = keys // (base * base), keys // base % base, keys % base
                    held.setdefault(lang, []).append(((wide[a] << 2 * _BITS) + (wide[b] << _BITS) + wide[c], n))
            if sum(len(k) for parts in held.values() for k, _ in parts) > _HELD:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    return rows.mapInPandas(count, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Profiles:
    """Ranked n-grams of every language: at most `top` a language."""

    langs: list[str]
    keys: np.ndarray  # sorted n-grams of all profiles
    ranks: np.ndarray  # keys x langs, `top` where absent
    top: int


def fit_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 300) -> Profiles:
    """Count over all given rows; only the `top` n-grams of each language reach the driver."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "ngram")
    ranked = (
        ngram_counts(docs, text_col, lang_col)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= top)  # the optimiser keeps the first `top` of each task before the shuffle
        .select("lang", "ngram", (F.col("place") - 1).alias("rank"))
        .toPandas()
    )
    langs = sorted(ranked["lang"].unique())
    keys = np.unique(ranked["ngram"].to_numpy(np.int64))
    ranks = np.full((len(keys), len(langs)), top, dtype=np.int64)
    column = ranked["lang"].map({v: k for k, v in enumerate(langs)}).to_numpy(np.int64)
    ranks[np.searchsorted(keys, ranked["ngram"].to_numpy(np.int64)), column] = ranked["rank"]
    return Profiles(langs, keys, ranks, top)


def _top_ngrams(points: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams in rank order; equal counts by n-gram."""
    alphabet, dense = np.unique(points, return_inverse=True)
    base = len(alphabet) + 1
    keys = _ngrams(points, dense.astype(np.int64) + 1, base)
    keys = np.sort(keys.astype(np.int32) if base**3 < 2**31 else keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    order = (np.int64(len(keys)) - counts) * len(keys) + np.arange(len(counts))
    if len(order) > top:
        order = np.partition(order, top - 1)[:top]
    chosen = keys[first[np.sort(order) % len(keys)]].astype(np.int64)
    wide = np.concatenate(([0], alphabet))
    a, b, c = chosen // (base * base), chosen // base % base, chosen % base
    return (wide[a] << 2 * _BITS) + (wide[b] << _BITS) + wide[c]


def closest(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """Nearest language, and one minus its distance as a share of the largest possible."""
    points = _code_points(text)
    if not profiles.langs or not (points != _PAD).any():
        return UNDETERMINED, 0.0
    grams = _top_ngrams(points, profiles.top)
    at = np.searchsorted(profiles.keys, grams)
    at[at == len(profiles.keys)] = 0
    known = profiles.keys[at] == grams
    ranks = np.where(known[:, None], profiles.ranks[at], profiles.top)
    apart = np.where(ranks == profiles.top, profiles.top, np.abs(ranks - np.arange(len(grams))[:, None])).sum(axis=0)
    best = int(apart.argmin())
    return profiles.langs[best], float(1 - apart[best] / (profiles.top * len(grams)))


def labelled(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """All columns of every row, with lang_pred and language_score added (columns of these names are
    replaced); no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x top entries

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [closest(t, sent.value) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "language_score"],
            )

    rows = docs.drop("lang_pred", "language_score")
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("language_score", DoubleType())])
    return rows.mapInArrow(label, schema)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; no shuffle."""
    found = labelled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), profiles)
    return found.select(F.col("id").alias(id_col), "lang_pred", F.col("language_score").alias("score"))


def held_out_predictions(docs: DataFrame, top: int = 300) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 4 is not 2, predict all rows."""
    profiles = fit_profiles(docs.filter(remainder("doc_id", 4) != 2), top=top)
    return identify(docs, profiles).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
