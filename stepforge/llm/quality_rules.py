"""Quality rules from tokeniser fertility (operator 4).

Every word of a text is encoded by a public byte-fallback vocabulary. Three
figures follow: characters per token, the share of byte-fallback tokens and
the entropy of the token distribution. A text whose figures leave the band of
its language (or, for an unknown language, of its main script) is rejected.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import WORD_PATTERN, Known, release, split_words


@dataclass(frozen=True)
class Band:
    """Limits that a text must keep to.

    chars_per_token: least and most. fallback: largest share of byte tokens.
    entropy: least share that the entropy has of the largest possible one for
    as many tokens, log2(min(tokens, vocabulary)).
    """

    chars_per_token: tuple[float, float]
    fallback: float
    entropy: float


#: By language, then by script for languages not named here. The least characters per token of the four languages
#: lie below the first percentile that rows labelled good have with the vocabulary piece_bpe_32k (3,980 labelled rows, the sample's bound).
BANDS: dict[str, Band] = {
    "en": Band((2.05, 6.5), 0.05, 0.35),
    "de": Band((2.05, 6.5), 0.05, 0.35),
    "fr": Band((1.8, 6.5), 0.05, 0.35),
    "es": Band((1.8, 6.5), 0.05, 0.35),
    "Latin": Band((1.4, 6.5), 0.10, 0.35),
    "Cyrillic": Band((1.2, 5.5), 0.10, 0.35),
    "Greek": Band((0.8, 4.0), 0.20, 0.35),
    "Hebrew": Band((0.7, 4.0), 0.30, 0.35),
    "Arabic": Band((0.7, 4.0), 0.30, 0.35),
    "Indic": Band((0.4, 4.0), 0.80, 0.30),
    "CJK": Band((0.3, 3.0), 0.80, 0.30),
    "Other": Band((0.25, 8.0), 0.95, 0.25),
}
#: First and last code point of each script's main blocks.
SCRIPTS: dict[str, tuple[tuple[int, int], ...]] = {
    "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F),),
    "Hebrew": ((0x590, 0x5FF),),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "Indic": ((0x900, 0xDFF),),
    "CJK": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0x20000, 0x3FFFF)),
}
SYMBOLS = "#*$%&|<>"
#: Bytes that a worker remembers words and their tokens in before it starts anew.
CACHE = 80 << 20
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_tokens long, n_fallback long, chars_per_token double, fallback_share double, token_entropy double, "
    "script string, kept boolean"
)
_WORD = re.compile(WORD_PATTERN)


def main_script(text: str) -> str:
    """The script that most letters of ``text`` belong to; ``Other`` without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = {k: sum(int(((points >= a) & (points <= b)).sum()) for a, b in v) for k, v in SCRIPTS.items()}
    best = max(found, key=found.get)
    return best if found[best] else "Other"


def repeated_words(a: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur at least twice in the text; ``a``: each word's number, below ``distinct``."""
    n = len(a)
    if n < 4:
        return 0
    pair = a[:-1] * distinct + a[1:]
    if distinct > 2_000_000:  # a third factor would not fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * distinct + a[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(lines) - len(set(lines))


class _Tokens:
    """Token ids of words; what was encoded is remembered, up to CACHE bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        if len(self.is_byte) > 1 << 16:
            raise ValueError("vocabularies of more than 65536 tokens need wider ids")
        self.known: dict[str, bytes] = {}
        self.taken = 0

    def counts(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """How often each token occurs in distinct words that occur so many times each."""
        found = list(map(self.known.get, words))
        if new := [w for w, x in zip(words, found) if x is None]:
            if self.taken > CACHE:
                self.known.clear()
                self.taken = 0
            more = [array("H", x).tobytes() for x in self.model.encode(new, num_threads=1)]
            self.known.update(zip(new, more))
            self.taken += sum(map(sys.getsizeof, new)) + sum(map(sys.getsizeof, more)) + Known.ENTRY * len(new)
            rest = iter(more)
            found = [next(rest) if x is None else x for x in found]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        return np.bincount(np.frombuffer(b"".join(found), np.uint16), np.repeat(times, size))


def measure(text: str, lang: str | None, tokens: _Tokens, bands: dict[str, Band], min_words: int, max_repeat: int):
    words = split_words(text)
    n = len(words)
    number = dict(zip(dict.fromkeys(words), range(n)))
    distinct = list(number)
    place = np.fromiter(map(number.__getitem__, words), np.int64, n)
    times = np.bincount(place, minlength=len(distinct))
    chars = int(times @ np.fromiter(map(len, distinct), np.int64, len(distinct)))
    n_repeat = repeated_words(place, len(distinct))
    base_failed = n < min_words or 100 * n_repeat > max_repeat * n
    counts = tokens.counts(distinct, times)
    n_tokens = int(counts.sum())
    fallback = int(counts[tokens.is_byte[: len(counts)]].sum()) if n_tokens else 0
    counts = counts[counts > 0]
    entropy = max(0.0, float(np.log2(n_tokens) - (counts * np.log2(counts)).sum() / n_tokens)) if n_tokens else 0.0
    per_token, share = (chars / n_tokens, fallback / n_tokens) if n_tokens else (0.0, 0.0)
    script = None
    if (band := bands.get(lang)) is None:
        script = main_script(text)
        band = bands.get(script, bands["Other"])
    most = np.log2(min(n_tokens, len(tokens.is_byte))) if n_tokens > 1 else 1.0
    kept = (
        not base_failed
        and band.chars_per_token[0] <= per_token <= band.chars_per_token[1]
        and share <= band.fallback
        and entropy >= band.entropy * most
    )
    symbols = sum(map(text.count, SYMBOLS))
    return n, chars, symbols, duplicate_lines(text), n_repeat, base_failed, n_tokens, fallback, per_token, share, entropy, script, bool(kept)


def quality_rules(
    docs: DataFrame,
    vocabulary: str,
    text: str = "text",
    lang: str | None = "lang",
    out: str = "quality",
    bands: dict[str, Band] = BANDS,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """``docs`` with a struct column ``out``: base figures, fertility figures and ``kept``.

    vocabulary: path of a SentencePiece model with byte fallback, present on
    every executor. One pass, no shuffle; rows, their order and all other
    columns stay as they are, repeated rows get equal results.

    NULL text counts as empty: no words, so ``base_failed`` and not kept. A
    NULL or unknown language falls back to the text's main script. A column
    already named ``out`` is replaced. An empty table gives an empty table.
    Texts are read whole; one text must fit in a worker's memory.
    """
    names = SCHEMA.split(", ")
    columns = [x.split(" ")[0] for x in names]

    @F.arrow_udf(SCHEMA)
    def rules(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tokens = _Tokens(vocabulary)
        for texts, langs in batches:
            rows = []
            for t, k in zip(texts, langs):
                rows.append(measure(t.as_py() or "", k.as_py(), tokens, bands, min_words, max_repeat_percent))
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], columns)
        release()

    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[x.split(" ")[1]] for x in names]
    language: Column = F.lit(None).cast("string") if lang is None else F.col(lang)
    return docs.withColumn(out, rules(F.col(text), language))
