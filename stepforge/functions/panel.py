"""Captured HTML panels to plain text, with or without markup spans.

Rules: character references are decoded; ``br`` gives a line feed (its end tag
nothing); comments and declarations go; the bodies of script and style stay. A
span covers what lies between a start tag and the end tag that takes it from
the stack of open tags, whatever its name; spans come in the order in which
they end, without those that are empty or have no class.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PARSED = "text string, spans array<struct<start:int,end:int,kind:string>>"
_PARSED = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))])
#: Bytes of panels that stand in a worker's memory as strings at a time, with what they give.
PORTION = 1 << 18


class _Panel(HTMLParser):
    """Collects a panel's plain text, and for each tag its place in the text: (place, class) or, for an end, (place, _END)."""

    _END = object()

    def __init__(self, content: str):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.length = 0
        self.marks: list[tuple[int, object]] = []
        self.feed(content)
        self.close()

    def handle_data(self, data):
        self.pieces.append(data)
        self.length += len(data)

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.handle_data("\n")

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            return self.handle_data("\n")
        self.marks.append((self.length, dict(attrs).get("class")))  # the last of equal names counts

    def handle_endtag(self, tag):
        if tag != "br":
            self.marks.append((self.length, self._END))

    def spans(self) -> list[tuple[int, int, str]]:
        """Start and end marks matched like brackets; surplus ends match nothing."""
        waiting: list[tuple[int, object]] = []
        found = []
        for place, name in self.marks:
            if name is not self._END:
                waiting.append((place, name))
            elif waiting:
                begin, kind = waiting.pop()
                found += [(begin, place, kind)] if kind and begin < place else []
        return found


def parse_panel(content: str | None) -> tuple[str, list[tuple[int, int, str]]]:
    """Text and spans (start, end, kind) of one panel; NULL and '' give ''."""
    if not content:
        return "", []
    panel = _Panel(content)
    return "".join(panel.pieces), panel.spans()


def portions(batches: Iterator[pa.Array], size: int = PORTION) -> Iterator[list[str | None]]:
    """The strings of some arrays in turn, as many at a time as have ``size`` bytes, or one longer string."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
            yield batch[at:to].to_pylist()
            at = to


def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The text of each panel, in smaller arrays."""
    for panels in portions(batches):
        yield pa.array([parse_panel(x)[0] for x in panels], pa.string())


def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Text and spans of each panel, in smaller arrays."""
    for panels in portions(batches):
        rows = [{"text": t, "spans": [{"start": a, "end": b, "kind": k} for a, b, k in s]} for t, s in map(parse_panel, panels)]
        yield pa.array(rows, _PARSED)


def panel_text(content: str | Column) -> Column:
    """Plain text of a panel, an Arrow-batched UDF."""
    return F.arrow_udf(texts, "string")(content)


def panel_parse(content: str | Column) -> Column:
    """Struct of text and spans of a panel, an Arrow-batched UDF."""
    return F.arrow_udf(parsed, PARSED)(content)
