"""Shared parts: tables written to the shared folder, components, word splitting."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space (bytes, UTF-8 safe).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: White space for ``str.split`` that stands inside words.
_INSIDE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_WORD = re.compile(WORD_PATTERN)


def split_words(text: str) -> list[str]:
    """The words of a text, as ``WORD_PATTERN`` finds them."""
    return _WORD.findall(text) if any(map(text.__contains__, _INSIDE)) else text.split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see. Where none is set, a temporary one, if executors are threads of this machine (tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir() or ""
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='stepforge-')}"
        context.setCheckpointDir(named)
    return named.rstrip("/")


class Known(dict):
    """What ``make`` gives for each string, remembered in at most about ``most`` bytes.

    When half of them are taken, what was not asked for since the last such
    moment is forgotten, so common strings stay.
    """

    #: What an entry takes besides its key and value.
    ENTRY = 90

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.taken, self.before = make, most // 2, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self.taken += sys.getsizeof(key) + sys.getsizeof(value) + self.ENTRY
        if self.taken > self.most:
            self.before, self.taken = dict(self), 0
            self.clear()
        self[key] = value
        return value

    def joined(self, parts: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, parts))


def chunks(batches: Iterator[pa.RecordBatch], *columns: str, rows: int = 512) -> Iterator[list[list]]:
    """The values of some columns, a few rows at a time, so that texts don't stand in memory twice for whole batches.

    What a task has left in its allocators goes back at the end: workers are
    used again, for other operators too.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [part.column(c).to_pylist() for c in columns]
    release()


def slices(batches: Iterator[pa.RecordBatch], *columns: str, size: int = 4 << 20) -> Iterator[list[pa.Array]]:
    """Some columns, as many rows at a time as their last one, of strings, has ``size`` bytes for, or one longer row."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(columns[-1])), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
            part = batch.slice(at, to - at)
            yield [part.column(c) for c in columns]
            at = to


def release() -> None:
    """Gives memory that is free, but kept by the allocators, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Scratch:
    """Tables in the shared folder that cut lineage and survive lost executors.

    They go when the JVM ends, or earlier through ``drop``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.top = f"{shared_folder(spark)}/stepforge-{uuid.uuid4().hex}"
        self.n = 0
        self._fs().deleteOnExit(self._path(self.top))

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.top).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back; the new frame has ``.scratch_path``."""
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._fs().delete(self._path(df.scratch_path), True)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` for each node of ``edges(a, b)``: the smallest id it reaches.

    Alternating large-star and small-star rounds; the number of rounds grows
    with the logarithm of the graph's diameter. Every round is a table in the
    shared folder, nothing but two check sums reaches the driver. Self-links
    and NULL ends are left out. A hub's links are pre-aggregated (min) and the
    joins are plain equi-joins, which Spark splits where a hub is skewed.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = scratch.write(edges.where("a <> b").select(u, v).distinct())
    before = None
    while True:
        if now.isEmpty():
            break
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large.where("u <> v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = scratch.write(small.union(least).distinct())
        scratch.drop(large, now)
        now = then
        total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if total == before:
            break
        before = total
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
