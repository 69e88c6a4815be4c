"""Removal of passages that repeat across documents, located by phrase automata.

A window is `window` consecutive words (`[^\\x20\\x09-\\x0D]+`) of a document.  Every word covered by
a window whose word sequence also starts in a document with a smaller id is removed; windows are
judged on the input.

1. Phrases.  In every window the run of `phrase` words with the smallest hash is its anchor.  Equal
   windows have equal anchors, and neighbouring windows share theirs, so there is about one anchor
   in 22 words.  Anchors met in two different texts are the confirmed phrases.  A phrase is written
   with 16 bits a word; where in a document it was met is not kept.
2. Automata.  Documents are dealt into shards of about `shard_words` words by hash.  A confirmed
   phrase goes to every shard one of whose documents holds it.  Each shard compiles its phrases into
   one Aho-Corasick automaton and streams all its documents through it, which locates every
   occurrence.  (Streaming every document through the phrases of all shards would find the same, at a
   cost that grows with the square of the corpus.)
3. Windows whose anchor was located are compared by hash across all documents: each shard puts out
   its distinct hashes with their smallest and largest id, and gets back, for each that a smaller id
   has elsewhere, that id.  A second stream over the documents with such windows cuts the words.

Documents whose words equal those of a smaller id are removed whole without further work, if they
have a window at all.  Windows are told apart by 96 bits, a hash and a check: with n windows compared,
a false match is expected about n^2 / 2^97 times (6e-4 for 10^13).  128 bits would write more than the
disk this is allowed.  Texts that are copies as wholes are told by 128 bits.

Defined cases: null, empty and blank texts have no words and stay as they are; a null id counts
neither as smaller nor as larger, so nothing of it is removed and it is no source; rows that repeat
an id are judged alike and not against each other; an empty table gives an empty table; only the
named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nivalis.llm.components import with_least
from nivalis.llm.tables import carried, discard, settle
from nivalis.llm.words import HashTable, Words, by_bytes, mix, split_words, window_hashes

#: Words that a phrase may have: 16 bits each, in two longs.
_MOST = 8
_CHECK = np.uint64(0xD6E8FEB86659FD93)
_PHRASE, _COPY, _DOC, _NO_ID = range(4)


def _anchors(words: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """For each window the place of its anchor."""
    grams = window_hashes(words, phrase)
    return sliding_window_view(grams, window - phrase + 1).argmin(axis=1) + np.arange(len(words) - window + 1)


def _written(words: np.ndarray, places: np.ndarray, phrase: int) -> np.ndarray:
    """The distinct phrases at the places, as pairs of longs."""
    codes = np.zeros((len(places), _MOST), dtype=">u2")
    codes[:, :phrase] = (words & np.uint64(0xFFFF)).astype(np.uint16)[places[:, None] + np.arange(phrase)]
    return np.unique(codes.view(">u8").astype(np.uint64), axis=0).view(np.int64)


def _letters(codes: np.ndarray) -> str:
    """Word codes as text, three letters a word; the alphabets of the three differ, so that a match
    begins at a word, and are small, as the automaton looks through a node's letters one by one."""
    out = np.empty((codes.size, 3), dtype="<u2")
    flat = codes.ravel()
    out[:, 0], out[:, 1], out[:, 2] = 0x100 + (flat >> 10), 0x200 + (flat >> 5 & 31), 0x300 + (flat & 31)
    return out.tobytes().decode("utf-16-le")


class PhraseAutomaton:
    """Locates phrases, given as pairs of longs, in sequences of word hashes."""

    def __init__(self, phrases: np.ndarray, phrase: int):
        import ahocorasick

        self.size, self.automaton = phrase, ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        codes = phrases.astype(">i8").view(">u2").reshape(-1, _MOST)[:, :phrase].astype(np.uint16)
        text, step = _letters(codes), 3 * phrase
        for k in range(0, len(text), step):
            self.automaton.add_word(text[k : k + step])
        self.automaton.make_automaton()

    def places(self, words: np.ndarray) -> np.ndarray:
        """Where a phrase begins."""
        if len(self.automaton) == 0 or len(words) < self.size:
            return np.zeros(0, np.int64)
        text = _letters((words & np.uint64(0xFFFF)).astype(np.uint16))
        ends = np.fromiter((end for end, _ in self.automaton.iter(text)), dtype=np.int64)
        return (ends + 1) // 3 - self.size


def _named(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and check of each window."""
    return window_hashes(words, window).view(np.int64), (window_hashes(mix(words ^ _CHECK), window) >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Sources:
    """The smallest id that has a window, by its hash and check. Windows of one hash but different checks
    lie in tables of their own."""

    def __init__(self, hashes: np.ndarray, checks: np.ndarray, least: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        hashes, checks, least = hashes[order], checks[order], least[order]
        nth = np.arange(len(hashes)) - np.searchsorted(hashes, hashes)
        self.tables = []
        for k in range(int(nth.max(initial=-1)) + 1):
            own = nth == k
            self.tables.append((HashTable(hashes[own].view(np.uint64)), checks[own], least[own]))

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Per window the id, or the largest number."""
        out = np.full(len(hashes), np.iinfo(np.int64).max)
        for table, own, least in self.tables:
            at = table.find(hashes.view(np.uint64))
            hit = np.flatnonzero((at >= 0) & (own[at] == checks))
            out[hit] = least[at[hit]]
        return out


def _digest(words: np.ndarray) -> tuple[int, int]:
    return struct.unpack("<2q", hashlib.blake2b(words.tobytes(), digest_size=16).digest())


def _joined(words: Words, k: int) -> list[bytes]:
    data, own = words.data, words.doc(k)
    if own.start == own.stop:
        return []
    return data[words.starts[own.start] : words.ends[own.stop - 1]].tobytes().split()


def anchor_table(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(doc_id, th, n_words, digest, digest_more, first, second) of each (doc_id, th, text) row; the last
    two are the halves of its anchor phrases."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.int64)
        for pdf in batches:
            texts, out = pdf["text"].tolist(), []
            for lo, hi in by_bytes(texts):
                words = split_words(texts[lo:hi])
                for k in range(hi - lo):
                    own = words.hashes[words.doc(k)]
                    if len(own) < window:
                        out.append((len(own), 0, 0, none, none))
                        continue
                    found = _written(own, np.unique(_anchors(own, window, phrase)), phrase)
                    out.append((len(own), *_digest(own), found[:, 0], found[:, 1]))
            made = pd.DataFrame(out, columns=["n_words", "digest", "digest_more", "first", "second"])
            yield made.assign(doc_id=pdf["doc_id"].to_numpy(), th=pdf["th"].to_numpy())

    rows = docs.select(carried("doc_id").alias("doc_id"), "th", "text")
    made = rows.mapInPandas(run, "n_words long, digest long, digest_more long, first array<long>, second array<long>, doc_id string, th long")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, int, int, pd.DataFrame]]:
    """Rows of one shard and kind each, in a stream sorted by them: whether the shard begins, the
    shard, the kind and the rows."""
    last = None
    for pdf in batches:
        shard, kind = pdf["shard"].to_numpy(), pdf["kind"].to_numpy()
        edge = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(pdf)], strict=True):
            if a < b:
                yield shard[a] != last, int(shard[a]), int(kind[a]), pdf.iloc[a:b]
                last = shard[a]


def _streamed(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard", "kind")


def located_windows(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """rows: shard, kind, a, b, text; phrases (a, b), copies (id a, hash of text b) and documents (the
    same, and the text). Documents without a located window get their final result, the others keep
    their text; other rows list the hashes of located windows with their smallest and largest id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases, copies, automaton = [], set(), None
        for begins, shard, kind, pdf in _parts(batches):
            if begins:
                phrases, copies, automaton = [], set(), None
            if kind == _PHRASE:
                phrases.append(pdf[["a", "b"]].to_numpy(np.int64))
                continue
            if kind == _COPY:
                copies.update(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True))
                continue
            if automaton is None:
                automaton = PhraseAutomaton(np.concatenate([np.zeros((0, 2), np.int64), *phrases]), phrase)
            ids, hashes_of_text, texts = pdf["a"].tolist(), pdf["b"].tolist(), pdf["text"].tolist()
            out, hashes, checks, owners = [], [], [], []
            for lo, hi in by_bytes(texts):
                words = split_words(texts[lo:hi])
                for k in range(lo, hi):
                    own = words.hashes[words.doc(k - lo)]
                    if kind == _DOC and (ids[k], hashes_of_text[k]) in copies:
                        out.append((kind, ids[k], len(own), len(own), hashlib.sha256(b"").hexdigest(), None))
                        continue
                    if kind == _DOC and len(own) >= window:
                        hit = np.zeros(len(own), dtype=bool)
                        hit[automaton.places(own)] = True
                        starts = np.flatnonzero(hit[_anchors(own, window, phrase)])
                        if len(starts):
                            value, check = _named(own, window)
                            hashes.append(value[starts])
                            checks.append(check[starts])
                            owners.append(np.full(len(starts), ids[k]))
                            out.append((kind, ids[k], len(own), 0, None, texts[k]))
                            continue
                    out.append((kind, ids[k], len(own), 0, hashlib.sha256(b" ".join(_joined(words, k - lo))).hexdigest(), None))
            made = pd.DataFrame(out, columns=["kind", "id", "n_words", "n_removed", "kept_sha256", "open_text"])
            yield made.assign(shard=shard, hashes=None, checks=None, low=None, high=None)
            if owners:
                owner, check, value = np.concatenate(owners), np.concatenate(checks), np.concatenate(hashes)
                order = np.lexsort((owner, check, value))
                owner, check, value = owner[order], check[order], value[order]
                first = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (check[1:] != check[:-1]))))
                last = np.append(first[1:] - 1, len(value) - 1)
                yield pd.DataFrame({
                    "kind": [_PHRASE], "id": 0, "n_words": 0, "n_removed": 0, "kept_sha256": None, "open_text": None, "shard": shard,
                    "hashes": [value[first]], "checks": [check[first]], "low": [owner[first]], "high": [owner[last]],
                })

    return _streamed(rows).mapInPandas(
        run,
        "kind int, id long, n_words long, n_removed long, kept_sha256 string, open_text string, shard int, "
        "hashes array<long>, checks array<int>, low array<long>, high array<long>",
    )


def cut_windows(rows: DataFrame, window: int) -> DataFrame:
    """rows: shard, kind, a, b, text, check; windows (hash a, check, smallest id b) and documents (id a). The words
    outside windows that a smaller id has stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sources = [], None
        for begins, _, kind, pdf in _parts(batches):
            if begins:
                held, sources = [], None
            if kind == _PHRASE:
                held.append([pdf[c].to_numpy(t) for c, t in (("a", np.int64), ("check", np.int32), ("b", np.int64))])
                continue
            if sources is None:
                none = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
                sources = Sources(*(np.concatenate(x) for x in zip(none, *held, strict=True)))
            out = []
            for doc_id, text in zip(pdf["a"].tolist(), pdf["text"], strict=True):
                words = split_words([text])
                split = _joined(words, 0)
                marked = np.flatnonzero(sources.find(*_named(words.hashes, window)) < doc_id)
                step = np.zeros(len(split) + 1, dtype=np.int64)
                step[: len(step) - window] += np.bincount(marked, minlength=len(step) - window)
                step[window:] -= np.bincount(marked, minlength=len(step) - window)
                gone = np.cumsum(step)[:-1] > 0
                kept = b" ".join(w for w, g in zip(split, gone.tolist(), strict=True) if not g)
                edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                out.append((
                    doc_id, len(split), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if gone.any() else None,
                    np.flatnonzero(edge == 1), np.flatnonzero(edge == -1),
                ))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "begins", "ends"])

    return _streamed(rows).mapInPandas(
        run,
        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, begins array<int>, ends array<int>",
    )


def _row(shard: Column | str, kind: int | Column, a: str, b: str, text: Column | None = None) -> list[Column]:
    """The columns of a stream of several kinds of rows."""
    kind = F.lit(kind) if isinstance(kind, int) else kind
    shard = F.col(shard) if isinstance(shard, str) else shard
    text = F.lit(None).cast("string") if text is None else text
    return [shard.alias("shard"), kind.alias("kind"), F.coalesce(a, F.lit(0)).alias("a"), F.col(b).alias("b"), text.alias("text")]


def strip_repeats(
    docs: DataFrame, window: int = 50, phrase: int = 8, shard_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept (the remaining words joined by one
    space; null where nothing was removed), and the removed words as begins[i]..ends[i]-1."""
    if not 0 < phrase <= min(_MOST, window):
        raise ValueError(f"a phrase has 1 to {min(_MOST, window)} words")
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th")
    )
    table = settle(anchor_table(docs, window, phrase), "anchors")
    total = table.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_words))
    shard = F.pmod(F.xxhash64("doc_id", "th"), F.lit(shards)).cast("int")

    long = table.filter(f"n_words >= {window} and doc_id is not null")
    judged = with_least(long.withColumn("u", F.struct("digest", "digest_more")).withColumnRenamed("doc_id", "v")).withColumnsRenamed({"v": "doc_id", "m": "first_id"})
    copies = judged.filter("doc_id > first_id").select(*_row(shard, _COPY, "doc_id", "th")).distinct()
    apart = judged.filter("doc_id = first_id").select(shard.alias("shard"), "digest", F.explode(F.arrays_zip("first", "second")).alias("p"))
    met = apart.groupBy("shard", "p.first", "p.second").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    met = settle(met, "phrases", tidy=True)  # a phrase has a row a shard at most, however common it is
    confirmed = met.groupBy("first", "second").agg(F.min("a").alias("least"), F.max("b").alias("most")).filter("least != most")
    phrases = met.join(confirmed, ["first", "second"]).select(*_row("shard", _PHRASE, "first", "second"))

    kind = F.when(F.col("doc_id").isNull(), _NO_ID).otherwise(_DOC)
    stream = phrases.unionByName(copies).unionByName(docs.select(*_row(shard, kind, "doc_id", "th", F.col("text"))))
    made = settle(located_windows(stream, window, phrase), "windows", tidy=True)
    discard(table, met)
    seen = made.filter(F.col("kind") == _PHRASE).select("shard", F.explode(F.arrays_zip("hashes", "checks", "low", "high")).alias("w")).select("shard", "w.*")
    least = F.min("low").over(Window.partitionBy("hashes", "checks"))  # a shard has few rows of a window
    marked = seen.withColumn("least", least).filter("least < high").select("shard", "hashes", "checks", "least").distinct()
    documents = made.filter(F.col("kind") != _PHRASE)
    cut = cut_windows(
        marked.select(*_row("shard", _PHRASE, "hashes", "least"), F.col("checks").alias("check")).unionByName(
            documents.filter("open_text is not null").select(*_row("shard", _DOC, "id", "n_words", F.col("open_text")), F.lit(0).alias("check"))
        ),
        window,
    )
    closed = documents.filter("open_text is null")
    gone = F.col("n_removed") > 0
    nowhere = F.array().cast("array<int>")
    closed = closed.select(
        F.when(F.col("kind") == _DOC, F.col("id")).alias("doc_id"),
        "n_words",
        "n_removed",
        "kept_sha256",
        F.when(gone, F.lit("")).alias("kept"),
        F.when(gone, F.array(F.lit(0))).otherwise(nowhere).alias("begins"),
        F.when(gone, F.array(F.col("n_words").cast("int"))).otherwise(nowhere).alias("ends"),
    )
    return closed.unionByName(cut).withColumnRenamed("doc_id", id_col)
