"""Near-duplicate documents by circulant MinHash (operator 5).

Two permutations give a whole signature: the first one scatters a text's
shingles over the places of a ring, the second one gives every place a rank,
and the k-th coordinate is the least rank of the scattered places after the
ring has been turned by k. Bands of coordinates propose pairs; the exact Jaccard
similarity of full shingle sets decides.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import Scratch, chunks, connected_components

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Places of the ring (the universe that shingles are scattered over).
RING = 1 << 18
#: Bytes whose words are hashed at once; a word is never cut.
PIECE = 1 << 20
_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (xor-shift and odd multiplication)."""
    x = (x ^ (x >> np.uint64(31))) * _ODD1
    x = (x ^ (x >> np.uint64(29))) * _ODD2
    return x ^ (x >> np.uint64(32))


def _hashes(piece: bytes) -> np.ndarray:
    raw = np.frombuffer(piece, np.uint8)
    at = np.flatnonzero(~_SPACE[raw])
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    return _mix(np.add.reduceat(_mix((place.astype(np.uint64) << np.uint64(8)) + _LOWER[raw[at]] + _ODD1), first))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words in ASCII lower case: the sum of a number for each byte at its place, mixed."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    while at < len(raw):
        gap = _GAP.search(raw, at + PIECE)
        to = gap.start() if gap else len(raw)
        out.append(_hashes(raw[at:to]))
        at = to
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class Shingles:
    """Sorted 64-bit hashes of a text's distinct shingles."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, text: str) -> np.ndarray:
        h = word_hashes(text)
        if not len(h):
            return h
        n = min(self.width, len(h))
        out = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            out = _mix(out * _ODD2 + h[k : k + len(out)])
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]


class CirculantSignature:
    """``size`` coordinates from two permutations of the ring."""

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.size = size
        self.scatter = rng.permutation(RING).astype(np.int32)
        ranks = rng.permutation(RING).astype(np.int32)
        turned = np.concatenate([ranks[-(size - 1) :], ranks]) if size > 1 else ranks
        # row s: the ranks of place s after turns by size - 1, ..., 1, 0
        self.ranks = np.lib.stride_tricks.sliding_window_view(turned, size)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        places = self.scatter[(shingles & np.uint64(RING - 1)).astype(np.int64)]
        if len(places) > RING:
            places = np.unique(places)
        out = np.full(self.size, RING, np.int32)
        for at in range(0, len(places), 2048):
            np.minimum(out, self.ranks[places[at : at + 2048]].min(axis=0), out=out)
        return out


def sketches(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """``doc_id, n_shingles, set_hi, set_lo, bands``: a 128-bit digest of the set, and a key for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signature = Shingles(width), CirculantSignature(bands * rows, seed)
        # coordinates of a band lie far from each other on the ring's turns
        number = _mix(np.arange(1, bands + 1, dtype=np.uint64))
        for docs, bodies in chunks(batches, "doc_id", "text"):
            out = []
            for doc, text in zip(docs, bodies):
                s = shingles(text)
                if not len(s):
                    out.append((doc, 0, 0, 0, []))
                    continue
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                hi, lo = np.frombuffer(d, "<i8")
                key = number
                for part in signature(s).reshape(rows, bands).astype(np.uint64):
                    key = _mix(key * _ODD1 + part)
                out.append((doc, len(s), hi, lo, key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], columns)

    columns = ["doc_id", "n_shingles", "set_hi", "set_lo", "bands"]
    types = [*[pa.int64()] * 4, pa.list_(pa.int64())]
    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>")


def candidate_links(bands: DataFrame) -> DataFrame:
    """``a, b``: each member of a bucket with its smallest member; ``bands(doc_id, bands)``.

    A bucket of any size gives one link per member, and the pairs it stands for
    stay in one connected component.
    """
    keyed = bands.select("doc_id", F.explode("bands").alias("band"))
    least = keyed.groupBy("band").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(least.select("band", "b"), "band").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join whatever ``percent`` similarity joins, as (place in left, place in right).

    Intersections of all pairs come from one sparse count per set of ``left``
    over an inverted index of ``right``; a link between two that are joined
    already is left out. right None: pairs within left.
    """
    own = right is None
    right = left if own else right
    n = len(right)
    sizes = np.array([len(x) for x in right])
    every = np.concatenate(right)
    order = np.argsort(every, kind="stable")
    values = every[order]
    holder = np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    distinct, first = np.unique(values, return_index=True)
    ends = np.append(first[1:], len(values))
    parent = list(range(n if own else len(left) + n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shift = 0 if own else len(left)
    for i, s in enumerate(left):
        at = np.searchsorted(distinct, s)
        at = at[distinct[np.minimum(at, len(distinct) - 1)] == s]
        starts, lengths = first[at], ends[at] - first[at]
        total = int(lengths.sum())
        if not total:
            continue
        picks = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(total)
        both = np.bincount(holder[picks], minlength=n)
        near = np.flatnonzero(100 * both >= percent * (sizes + len(s) - both))
        for j in near[near < i] if own else near:
            a, b = root(i), root(int(j) + shift)
            if a != b:
                parent[a] = b
                yield i, int(j)


def verified_links(texts: DataFrame, clusters: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """``a, b``: links that join all similar pairs of each cluster, from full shingle sets.

    texts: ``doc_id, text``; clusters: ``node, component``. Clusters of more
    than ``block`` texts are cut into blocks by hash, and every pair of blocks is
    a group of its own: what one task holds doesn't grow with the cluster.
    """
    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = clusters.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = dealt.withColumn("pair", F.explode(pairs))
    # the same join at every size: with few clusters a broadcast would do, but the plan is not to change as they grow
    sent = texts.hint("merge").join(dealt, texts.doc_id == dealt.node).select("component", "pair.i", "pair.j", "own", "doc_id", "text")
    group = ["component", "i", "j"]
    sent = sent.repartition(*group).sortWithinPartitions(*group, "own", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        now, left, right = None, [], []

        def links() -> pa.RecordBatch:
            a, b = [x[1] for x in left], [x[1] for x in right]
            found = linked(a, b if right else None, percent) if left else ()
            pairs = [(left[i][0], (right or left)[j][0]) for i, j in found]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for part in chunks(batches, "component", "i", "j", "own", "doc_id", "text"):
            for c, i, j, own, doc, text in zip(*part):
                if (c, i, j) != now:
                    yield links()
                    now, left, right = (c, i, j), [], []
                (left if own == i else right).append((doc, shingles(text)))
        yield links()

    return sent.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 40,
    rows: int = 6,
    seed: int = 11,
    block: int = 2048,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if their sets of ``width``-word shingles (ASCII lower
    case; a shorter text is one shingle) have a Jaccard similarity of
    ``percent`` or more. component_id is the smallest doc_id reachable by links;
    ``kept`` is true for that document.

    A pair at a similarity of 0.85 shares no band with probability
    (1 - 0.85^6)^40 < 1e-8, one at 0.8 with 6e-6. Every pair proposed is decided on full sets.

    NULL, empty and blank texts have no shingles and link with nothing. Equal
    sets are one representative from the start, so copies without number cost
    one row each. doc_id must be an integer; rows that repeat a doc_id count as one document with each
    of its texts; rows with a NULL doc_id are left out. An empty table gives an empty
    table; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")
    all_rows = scratch.write(sketches(texts, width, bands, rows, seed))
    sets = all_rows.where("n_shingles > 0").groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("first"))
    first = all_rows.where("n_shingles > 0").join(sets, ["set_hi", "set_lo"]).select("doc_id", "first", "bands")
    clusters = connected_components(candidate_links(first.where("doc_id = first").select("doc_id", "bands").dropDuplicates(["doc_id", "bands"])), scratch)
    clusters = scratch.write(clusters)
    links = scratch.write(verified_links(texts, clusters, width, percent, block))
    copies = first.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    whole = connected_components(links, scratch)
    # a copy belongs to its representative's component; repeated doc_ids tie their sets together
    repeated = all_rows.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.count_distinct("set_hi", "set_lo").alias("n_sets"))
    if not repeated.where("n_sets > 1").isEmpty():
        whole = connected_components(links.union(copies), scratch)
        reach = repeated.join(whole, repeated.doc_id == whole.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    else:
        of = first.select("doc_id", "first").join(whole, F.col("first") == F.col("node"), "left").select("doc_id", F.coalesce("component", "first").alias("component_id")).distinct()
        reach = repeated.join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return reach.withColumn("kept", F.col("doc_id") == F.col("component_id"))
