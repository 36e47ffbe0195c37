"""Text columns: trimming, lines, carets, paths and goal states.

White space here is Unicode white space and the separators U+001C to U+001F,
as in Python's ``str.strip``; lengths and offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters at which Python's ``str.splitlines`` ends a line, CR LF first.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
_SPACE = r"[\s\x1C-\x1F]"
_CUT = "\x00"


def strip(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def rstrip(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), rf"(?U){_SPACE}+\z", "")


def split_lines(c: str | Column) -> Column:
    """The lines of a text without their ends; a final line end opens no further line."""
    parts = F.split(_col(c), LINE_ENDS)
    last_empty = F.try_element_at(parts, F.lit(-1)) == ""
    return F.when(last_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def first_word(c: str | Column) -> Column:
    """What stands before the first space of the stripped text; '' for a blank one."""
    return F.split_part(strip(c), F.lit(" "), F.lit(1))


def parent_name(path: str | Column) -> Column:
    """Name of the folder that a file path lies in; '' at the top level."""
    steps = F.filter(F.split(_col(path), "/"), lambda s: ~s.isin("", "."))
    return F.coalesce(F.try_element_at(steps, F.lit(-2)), F.lit(""))


def entry_under(path: str | Column, root: str) -> Column:
    """First folder below ``root``: the entry even if files are nested in it; NULL outside ``root``."""
    top = root.rstrip("/") + "/"
    inside = F.startswith(_col(path), F.lit(top))
    return F.when(inside, F.split_part(F.substr(_col(path), F.lit(len(top) + 1)), F.lit("/"), F.lit(1)))


def line_and_character(text: str | Column, offset: str | Column) -> tuple[Column, Column]:
    """1-based line and 0-based character of an offset (both in code points)."""
    before = F.substr(_col(text), F.lit(1), _col(offset).cast("int"))
    return F.size(F.split(before, "\n")), F.length(F.substring_index(before, "\n", -1))


def subgoals(state: str | Column) -> Column:
    """Number of open subgoals that a goal display names; 0 if it says there are none, else NULL."""
    n = F.regexp_extract(_col(state), r"goal \((\d+) subgoals?\)", 1)
    return F.when(n != "", n.cast("int")).when(F.contains(_col(state), F.lit("No subgoals")), 0)


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole to one decimal; a whole of 0 counts as 1."""
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), 1)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
