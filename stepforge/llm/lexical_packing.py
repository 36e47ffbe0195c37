"""Packing by lexical retrieval (operator 6).

Documents are tokenised once. Full windows go out as they are; what is left of
each document is packed with its neighbours: every shard of a BM25 inverted
index returns, for a seed, its unused neighbours in order of score, and they
fill the seed's window one after another. The one that doesn't fit is cut and
seeds the next window, so no window but a shard's last is short, and that one
is cut into powers of two.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import Known, Scratch, release, slices

K1, B = 1.2, 0.75
#: Terms of a seed that are looked up, by weight; neighbours that are ranked at once.
QUERY_TERMS, RANKED = 24, 32


class WordTokens:
    """Token ids of texts, as the ``tokenizers`` library gives them.

    Its tokens never span white space, so each distinct word of some texts is
    encoded once. Words of plain Latin letters, digits and ASCII signs are cut
    into the vocabulary's units here and go to the library's BPE model unit by
    unit, each one once while it is remembered. Normal forms and special tokens
    don't occur in them. All other words go through the library's whole pipeline.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # the same pattern for plain texts, with their letters and digits spelled out
        plain = [chr(c) for c in range(0x21, 0x180) if (c < 0x7F or c >= 0xC0) and c != 0x130]
        letters, digits = ("".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == k) for k in "LN")
        for name, own in (("[^\\s\\p{L}\\p{N}]", f"[^\\s{letters}{digits}]"), ("[\\p{L}]", f"[{letters}]"), ("[\\p{N}]", f"[{digits}]")):
            split = split.replace(name, own)
        if "\\p" in split:
            raise ValueError("the vocabulary cuts texts in another way than this class knows")
        self.units = re.compile(f"\n|{split}").findall
        self.plain = re.compile(f"[\n{''.join(map(re.escape, plain))}]*").fullmatch
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.bytes = str.maketrans({b: chr(256 + i) for i, b in enumerate(hidden)})
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        # one number more than the vocabulary has stands between words
        self.inner = np.dtype("<u2" if self.size < 1 << 16 else "<u4")
        self.known, self.others = Known(self._unit, 96 << 20), Known(self._word, 16 << 20)

    def _unit(self, unit: str) -> bytes:
        if unit == "\n":
            return array(self.inner.char, [self.size]).tobytes()
        shown = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.bytes)
        return array(self.inner.char, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        return array(self.inner.char, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _each(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (one a line) behind each other, with one number after each, and how many each word has."""
        other = []
        if "<|" in text or not self.plain(text):
            words = text.split("\n")
            other = [i for i, w in enumerate(words) if "<|" in w or not self.plain(w)]
            more = [np.frombuffer(self.others[words[i]], self.inner) for i in other]
            for i in other:
                words[i] = ""
            text = "\n".join(words)
        ids = np.frombuffer(self.known.joined(self.units(text.lower() + "\n")), self.inner)
        ends = np.flatnonzero(ids == self.size)
        if other:
            ids = np.insert(ids, np.repeat(ends[other], [len(x) for x in more]), np.concatenate(more))
            ends = np.flatnonzero(ids == self.size)
        return ids, np.diff(ends, prepend=-1) - 1

    def ids(self, texts: pa.Array, end_id: int, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, ``end_id`` after each, and where each text ends."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        every = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)
        each, size = self._each(pc.binary_join(every, "\n")[0].as_py())
        start = np.cumsum(size + 1) - size - 1
        each, size, start = np.append(each, np.array([end_id], self.inner)), np.append(size, 1), np.append(start, len(each))
        ends = lists.offsets.to_numpy()[1:]
        which = np.insert(words.indices.to_numpy(), ends, len(size) - 1)
        upto = np.cumsum(size[which])
        out = np.empty(upto[-1], self.dtype)
        for at in range(0, len(which), block):
            w = which[at : at + block]
            n, done = size[w], upto[at - 1] if at else 0
            out[done : upto[at + len(w) - 1]] = each[np.repeat(start[w] - (upto[at : at + block] - n - done), n) + np.arange(n.sum())]
        return out, upto[ends + np.arange(len(ends))]


@functools.lru_cache(1)
def word_tokens(path: str) -> WordTokens:
    """A worker keeps the vocabulary, and what is remembered, for its next tasks."""
    return WordTokens(path)


UNIT = "unit long, doc_id long, start long, length long, doc_tokens long, key1 int, key2 int, ids binary"


def tokenised(docs: DataFrame, path: str, window: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """Units: the full windows and the rest of every document; ``unit`` is unique.

    key1, key2: the two largest token ids of a unit. A BPE vocabulary numbers
    its merges by falling frequency, so these are its rarest terms, and units
    that share them come to lie in one shard. Rows without a ``unit`` count, for
    a term (``start``), the units of the task that hold it (``length``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        first, n, holding = TaskContext.get().partitionId() << 32, 0, np.zeros(tokens.size, np.int64)
        present = np.zeros(tokens.size, bool)
        for docs, bodies in slices(batches, "doc_id", "text"):
            rows, begin = [], 0
            ids, ends = tokens.ids(bodies, end_id)
            for doc, end in zip(docs.to_pylist(), ends.tolist()):
                for at in range(begin, end, window):
                    part = ids[at : min(at + window, end)]
                    present[part] = True
                    terms = np.flatnonzero(present)
                    present[terms] = False
                    holding[terms] += 1
                    low = int(terms[-2]) if len(terms) > 1 else 0
                    rows.append((first + n, doc, at - begin, len(part), end - begin, int(terms[-1]), low, part.tobytes()))
                    n += 1
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], columns)
        release()
        terms = np.flatnonzero(holding)
        count = {"start": pa.array(terms), "length": pa.array(holding[terms])}
        yield pa.RecordBatch.from_arrays([count.get(c, pa.nulls(len(terms), t)) for c, t in zip(columns, types)], columns)

    columns = [x.split(" ")[0] for x in UNIT.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split(" ")[1]] for x in UNIT.split(", ")]
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, UNIT)


class Shard:
    """BM25 inverted index over some units; ``windows`` packs them."""

    def __init__(self, units: list[np.ndarray], weight_of: np.ndarray, mean_length: float):
        self.n = len(units)
        # (unit, term) as one number: equal ones are counted by one sort
        pairs = np.concatenate([ids.astype(np.int64) + (i << 32) for i, ids in enumerate(units)])
        pairs, tf = np.unique(pairs, return_counts=True)
        holder, term, tf = (pairs >> 32).astype(np.int32), pairs & 0xFFFFFFFF, tf.astype(np.float32)
        self.ends = np.searchsorted(holder, np.arange(self.n + 1))
        length = np.array([len(u) for u in units], np.float32)
        weight = (weight_of[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[holder] / mean_length))).astype(np.float32)
        self.term, self.weight = term, weight
        order = np.argsort(term, kind="stable")
        self.holder, self.scored = holder[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(weight_of) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all units of the shard for the seed's weightiest terms."""
        a, b = self.ends[seed], self.ends[seed + 1]
        own, out = self.weight[a:b], np.zeros(self.n, np.float32)
        best = np.argpartition(-own, QUERY_TERMS)[:QUERY_TERMS] if b - a > QUERY_TERMS else np.arange(b - a)
        for t in self.term[a:b][best]:
            p = slice(self.first[t], self.first[t + 1])
            out[self.holder[p]] += self.scored[p]
        return out

    def windows(self, lengths: list[int], window: int) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (unit, start, length) that fill a window; the last one may be short."""
        unused, next_free = np.ones(self.n, bool), 0
        seed = rest = None
        filled, room = [], window
        while True:
            if seed is None:
                while next_free < self.n and not unused[next_free]:
                    next_free += 1
                if next_free == self.n:
                    break
                seed, rest = next_free, 0
                unused[seed] = False
            take = min(lengths[seed] - rest, room)
            filled.append((seed, rest, take))
            room -= take
            cut = (seed, rest + take) if rest + take < lengths[seed] else None
            if room:
                for other in self._neighbours(seed, unused):
                    unused[other] = False
                    take = min(lengths[other], room)
                    filled.append((other, 0, take))
                    room -= take
                    if not room:
                        cut = (other, take) if take < lengths[other] else None
                        break
                if room:
                    seed = None  # no neighbours are left: the next free unit goes on filling
                    continue
            yield filled
            filled, room = [], window
            seed, rest = cut or (None, None)
        if filled:
            yield filled

    def _neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        score = np.where(unused, self.scores(seed), 0)
        while True:
            if self.n > RANKED:
                top = np.argpartition(-score, RANKED)[:RANKED]
                top = top[np.argsort(-score[top], kind="stable")]
            else:
                top = np.argsort(-score, kind="stable")
            found = [int(i) for i in top if score[i] > 0]
            if not found:
                return
            yield from found
            score[found] = 0


def lexical_packing(
    docs: DataFrame,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = 4096,
    end_id: int = 2,
    shard_units: int = 4096,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ids: the piece's token ids, little-endian unsigned 32-bit. A document is its
    ids and then ``end_id``; every id lies in one piece. A sequence has
    ``window`` ids or, at the end of a shard, a power of two, so padding is none.

    NULL or empty text gives a document of ``end_id`` alone. A NULL doc_id stays
    NULL. Repeated rows are packed each on their own. An empty table gives an
    empty table. Other columns are not read. A text must fit in a worker.

    Scale: one narrow range shuffle of the documents' ends (full windows don't
    move), ordered by rare terms and then by a hash, so that copies without
    number split over shards and tasks. A shard holds at most ``shard_units``
    units of less than ``window`` ids, whatever the input. Term counts cover all
    documents; the driver gets one number per vocabulary entry.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    units = scratch.write(tokenised(docs, vocabulary, window, end_id, doc_id, text))
    total, mean = units.where("unit is not null").agg(F.count(F.lit(1)), F.avg("length")).first()
    counts = units.where("unit is null").groupBy("start").agg(F.sum("length")).collect()  # a row per vocabulary entry at most
    holding = np.zeros(max((r[0] for r in counts), default=0) + 1)
    for term, n in counts:
        holding[term] = n
    weight_of = np.log1p((total - holding + 0.5) / (holding + 0.5)).astype(np.float32)
    wide = "<u4"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n, held = TaskContext.get().partitionId() << 32, 0, []

        def shard() -> pd.DataFrame:
            nonlocal n
            kind = np.dtype("<u2" if holding.size <= 1 << 16 else wide)
            ids = [np.frombuffer(r[4], kind) for r in held]
            rows = []
            for filled in Shard(ids, weight_of, mean).windows([len(x) for x in ids], window):
                used, at = 0, 0
                size = sum(x[2] for x in filled)
                bit = 1 << (size.bit_length() - 1)
                for i, start, length in filled:
                    while length:
                        take = min(length, bit - used)
                        doc, first, _, doc_tokens, _ = held[i]
                        rows.append((doc, first + start, take, doc_tokens, (task + n) * 2 + 1, used, ids[i][start : start + take].astype(wide).tobytes()))
                        start, length, used, at = start + take, length - take, used + take, at + take
                        if used == bit:
                            n, used = n + 1, 0
                            bit = 1 << ((size - at).bit_length() - 1) if at < size else 0
            held.clear()
            return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

        for b in batches:
            for row in zip(b.doc_id, b.start, b.length, b.doc_tokens, b.ids):
                held.append(tuple(None if x is pd.NA or x != x else x for x in row[:4]) + row[4:])
                if len(held) == shard_units:
                    yield shard()
        if held:
            yield shard()

    def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = np.dtype("<u2" if holding.size <= 1 << 16 else wide)
        for b in batches:
            b["ids"] = [np.frombuffer(x, kind).astype(wide).tobytes() for x in b.ids]
            yield b

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    columns = [x.split(" ")[0] for x in schema.split(", ")]
    whole = units.where(F.col("unit").isNotNull() & (F.col("length") == window)).select(
        "doc_id", "start", "length", "doc_tokens", (F.col("unit") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids"
    )
    rest = units.where(F.col("unit").isNotNull() & (F.col("length") < window))
    dealt = rest.repartitionByRange("key1", "key2", F.xxhash64("unit")).sortWithinPartitions("key1", "key2", F.xxhash64("unit"), "unit")
    packed = dealt.select("doc_id", "start", "length", "doc_tokens", "ids").mapInPandas(pack, schema)
    return whole.mapInPandas(widen, schema).union(packed)
