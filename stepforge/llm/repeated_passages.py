"""Removal of repeated passages by level-wise doubling (operator 9).

Level 1: half-length windows are sampled so that any two equal full windows
share a sampled half at the same place (the least hash of every run of
consecutive halves is taken). Halves that only one document holds end there.
Level 2: only around halves that are repeated are windows of twice that length
formed and compared. The repeated ones can be doubled on, level by level, until
no candidate survives (``longest_repeats``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import WORD_PATTERN, Known, Scratch, chunks

_WORD = re.compile(WORD_PATTERN)
#: Bytes in which a worker remembers hashes of words.
CACHE = 96 << 20
#: Odd bases of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class WindowHashes:
    """Hashes of all windows of a text: two independent 64-bit polynomials of word hashes."""

    def __init__(self):
        self.known = Known(lambda w: hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest(), CACHE)
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in BASES]

    def words(self, words: list[str]) -> np.ndarray:
        """Two 64-bit hashes of each word, as the rows of an array."""
        return np.frombuffer(self.known.joined(words), "<u8").reshape(-1, 2).T

    def _power(self, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.powers[k]
        if len(up) < n:
            size = max(n, 2 * len(up))
            bases = BASES[k], pow(BASES[k], -1, 1 << 64)
            up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]), dtype=np.uint64) for b in bases)
            self.powers[k] = up, down
        return up[:n], down[:n]

    def windows(self, hashes: np.ndarray, size: int, k: int) -> np.ndarray:
        n = len(hashes)
        up, down = self._power(k, n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
        out = (total[size:] - total[:-size]) * down[: n - size + 1]
        out ^= out >> np.uint64(32)
        return out * np.uint64(BASES[1 - k])


def sample(hashes: np.ndarray, run: int) -> np.ndarray:
    """Places that are the least (the last one in a tie) of some ``run`` consecutive values."""
    if len(hashes) < run:
        return np.empty(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(hashes[::-1], run)
    at = np.arange(len(seen)) + seen.argmin(axis=1)
    return np.unique(len(hashes) - 1 - at)


def _sketch(texts: DataFrame, window: int) -> DataFrame:
    """Per document: words, digests of the word sequence, and the sampled halves (hash, place)."""
    half = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WindowHashes()
        none = np.empty(0, np.int64)
        for docs, bodies in chunks(batches, "doc_id", "text"):
            rows = []
            for doc, text in zip(docs, bodies):
                words = _WORD.findall(text)
                digest = hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()
                if len(words) < window:
                    rows.append((doc, len(words), digest, none, none))
                    continue
                h = hashes.windows(hashes.words(words)[0], half, 0)
                at = sample(h, window - half + 1)
                rows.append((doc, len(words), digest, h[at].view(np.int64), at))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], columns)

    columns = ["doc_id", "n_words", "sha256", "halves", "places"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return texts.mapInArrow(run, "doc_id long, n_words long, sha256 string, halves array<long>, places array<int>")


def _near(places: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Starts of the windows that hold one of the halves at ``places``."""
    half = (window + 1) // 2
    mark = np.zeros(n_words + 2, np.int32)
    np.add.at(mark, np.maximum(places - (window - half), 0), 1)
    np.add.at(mark, places + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: n_words - window + 1] > 0)


def _windows(around: DataFrame, window: int) -> DataFrame:
    """``h1, h2, doc_id, place`` of each candidate window; around: ``doc_id, text, places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WindowHashes()
        for part in chunks(batches, "doc_id", "text", "places"):
            for doc, text, places in zip(*part):
                words = _WORD.findall(text)
                own = hashes.words(words)
                at = _near(np.asarray(places), len(words), window)
                h = [hashes.windows(own[k], window, k)[at].view(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(np.full(len(at), doc)), pa.array(at.astype(np.int32))], ["h1", "h2", "doc_id", "place"])

    return around.select("doc_id", "text", "places").mapInArrow(_gathered(run), "h1 long, h2 long, doc_id long, place int")


def _gathered(run, rows: int = 100_000):
    """Batches of at least ``rows`` rows each, the last one excepted."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return wrapped


def _removed(texts: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all documents; exact copies of an earlier one; texts with the windows to remove."""
    sketch = scratch.write(_sketch(texts, window))
    long = sketch.where(F.col("n_words") >= window)
    # n_words, sha256: equal sequences of words. All but the first of them go as a whole.
    first = long.groupBy("n_words", "sha256").agg(F.min("doc_id").alias("doc_id"))
    copies = long.select("n_words", "sha256", "doc_id").join(first.withColumnRenamed("doc_id", "first"), ["n_words", "sha256"]).where("doc_id > first").select("doc_id").distinct()
    copies = scratch.write(copies)
    halves = long.join(copies, "doc_id", "left_anti").select("doc_id", F.explode(F.arrays_zip("halves", "places")).alias("x"))
    halves = halves.select("doc_id", F.col("x.halves").alias("half"), F.col("x.places").alias("place"))
    # written, so that the joins see plain tables and Spark can split a hot half or window
    repeated = scratch.write(halves.groupBy("half").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("half"))
    survivors = halves.join(repeated, "half").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    around = scratch.write(texts.join(survivors, "doc_id"))
    windows = scratch.write(_windows(around, window))
    earliest = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    earliest = scratch.write(earliest.select("h1", "h2", "low"))
    again = windows.join(earliest, ["h1", "h2"]).where("doc_id > low")
    again = again.groupBy("doc_id").agg(F.collect_list("place").alias("removed"))
    return sketch, copies, around.drop("places").join(again, "doc_id")


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, scratch: Scratch | None = None
) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256, spans``.

    A word goes if a window of ``window`` consecutive words covers it whose
    word sequence also starts in a document with a smaller doc_id, judged on the
    texts as they came in. spans: (start, length) in words of what goes, joined,
    NULL where all of a copy goes or nothing does. kept_sha256: of the kept
    words joined by single spaces.

    Texts shorter than ``window`` words, NULL and empty ones lose nothing.
    doc_id must be an integer; of rows that repeat one, the first by text is
    looked at; rows with a NULL doc_id are left out. An empty table gives an
    empty table; other columns are not read.

    Windows are compared by 128-bit hashes. What a common passage shuffles is
    one row per occurrence, aggregated before the shuffle; the joins that
    bring results back are plain equi-joins, which Spark splits at hot keys.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")
    if not texts.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = scratch.write(texts.groupBy("doc_id").agg(F.min("text").alias("text")))
    sketch, copies, removed = _removed(texts, window, scratch)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, starts in zip(b.doc_id, b.text, b.removed):
                words = _WORD.findall(text)
                mark = np.zeros(len(words) + 1, np.int32)
                starts = np.asarray(starts)
                np.add.at(mark, starts, 1)
                np.add.at(mark, starts + window, -1)
                gone = np.cumsum(mark)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = [{"start": int(a), "length": int(z - a)} for a, z in zip(edges[::2], edges[1::2])]
                kept = " ".join([w for w, g in zip(words, gone) if not g])
                rows.append((doc, int(gone.sum()), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), spans))
            yield pd.DataFrame(rows, columns=["doc_id", "__n", "__sha", "spans"])

    parts = removed.mapInPandas(cut, "doc_id long, __n long, __sha string, spans array<struct<start:long,length:long>>")
    whole = sketch.select("doc_id", "n_words", "sha256").join(copies.withColumn("__copy", F.lit(True)), "doc_id", "left").join(parts, "doc_id", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select(
        "doc_id", "n_words",
        F.when(F.col("__copy"), F.col("n_words")).otherwise(F.coalesce("__n", F.lit(0))).alias("n_removed"),
        F.when(F.col("__copy"), nothing).otherwise(F.coalesce("__sha", "sha256")).alias("kept_sha256"), "spans",
    )


def longest_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, longest``: the largest of ``window * 2^k`` at which a window of the document repeats in another one.

    Windows that repeat at one length alone, both halves of them, are extended
    to twice that length; it ends when no candidate survives. Exact copies count.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null").dropDuplicates(["doc_id"])
    sketch = scratch.write(_sketch(texts, window))
    halves = sketch.select("doc_id", F.explode(F.arrays_zip("halves", "places")).alias("x")).select("doc_id", F.col("x.halves").alias("half"), F.col("x.places").alias("place"))
    repeated = halves.groupBy("half").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("half")
    survivors = halves.join(repeated, "half").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    now, length, found = _windows(texts.join(survivors, "doc_id"), window), window, []
    while True:
        shared = now.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h1", "h2")
        now = scratch.write(now.join(shared, ["h1", "h2"]))
        if now.isEmpty():
            break
        found.append(now.select("doc_id").distinct().withColumn("longest", F.lit(length)))
        later = now.select("doc_id", (F.col("place") - length).alias("place"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
        now = now.join(later, ["doc_id", "place"]).select(F.xxhash64("h1", "g1", F.lit(1)).alias("h1"), F.xxhash64("h2", "g2", F.lit(2)).alias("h2"), "doc_id", "place")
        length *= 2
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, longest int")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.groupBy("doc_id").agg(F.max("longest").alias("longest"))
