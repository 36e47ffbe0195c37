"""Session files: which sessions, with which parents and theories.

``session NAME (groups) in "DIR" = PARENT +`` and its sections; comments and
archive-level files without a session give nothing.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.functions.segment import tokens

SESSIONS = (
    "array<struct<session:string,groups:array<string>,in_dir:string,parent:string,description:string,options:map<string,string>,"
    "sessions:array<string>,directories:array<string>,document_files:array<string>,export_files:array<string>,"
    "theories:array<struct<name:string,opts:map<string,string>,is_global:boolean>>>>"
)
LISTS = frozenset(("sessions", "directories", "document_files", "export_files"))
SECTIONS = LISTS | {"options", "theories", "description", "document_theories", "export_classpath"}


def _plain(value: str) -> str:
    return re.sub(r'^(?:"|`|\\<open>|‹|\{\*)|(?:"|`|\\<close>|›|\*\})$', "", value)


class _Reader:
    """Atoms of a session file: bare names (joined over - and .), quoted ones and signs."""

    def __init__(self, text: str):
        self.atoms, end = [], -1
        for kind, value, start, stop in tokens(text):
            quoted = kind in ("string", "cartouche", "verbatim", "back")
            name = quoted or kind in ("word", "number") or value in ("-", ".", "_", "/", "$")
            if name and not quoted and start == end and self.atoms and self.atoms[-1][1] == "bare":
                self.atoms[-1] = (self.atoms[-1][0] + value, "bare")
            else:
                self.atoms.append((_plain(value) if quoted else value, "quoted" if quoted else "bare" if name else "sign"))
            end = stop
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.atoms[self.at] if self.at < len(self.atoms) else ("", "end")

    def take(self) -> str:
        self.at += 1
        return self.atoms[self.at - 1][0] if self.at <= len(self.atoms) else ""

    def skip(self, sign: str) -> bool:
        if self.peek()[0] == sign and self.peek()[1] != "quoted":
            self.at += 1
            return True
        return False

    def keyword(self) -> bool:
        return self.peek()[1] == "end" or (self.peek()[1] == "bare" and self.peek()[0] in SECTIONS | {"session", "chapter", "chapter_definition"})

    def options(self) -> dict[str, str]:
        """What stands in brackets: name = value, or a bare name for true."""
        out: dict[str, str] = {}
        if self.skip("["):
            while self.peek()[1] != "end" and not self.skip("]"):
                name = self.take()
                out[name] = self.take() if self.skip("=") else "true"
                self.skip(",")
        return out

    def names(self) -> list[str]:
        out = []
        while not self.keyword():
            if self.peek()[1] == "sign":
                self.skip("(") and self._close() or self.take()
            else:
                out.append(self.take())
        return out

    def _close(self) -> bool:
        while self.peek()[1] != "end" and not self.skip(")"):
            self.take()
        return True


def _theories(r: _Reader) -> list[dict]:
    opts, out = r.options(), []
    while not r.keyword():
        if r.peek()[1] == "sign":
            r.take()
            continue
        name, is_global = r.take(), False
        if r.skip("("):
            is_global = r.peek()[0] == "global"
            r._close()
        out.append({"name": name, "opts": opts, "is_global": is_global})
    return out


def parse_root(text: str | None) -> list[dict]:
    """The sessions of one session file, in order."""
    r, out = _Reader(text or ""), []
    while r.peek()[1] != "end":
        if not r.skip("session"):
            r.take()
            continue
        s: dict = {"session": r.take(), "groups": [], "in_dir": None, "parent": None, "description": None, "options": {}, "theories": []}
        s |= {k: [] for k in LISTS}
        if r.skip("("):
            while r.peek()[1] != "end" and not r.skip(")"):
                s["groups"].append(r.take())
        if r.skip("in"):
            s["in_dir"] = r.take()
        if r.skip("="):
            first = r.take()
            if r.skip("+"):
                s["parent"] = first
            else:
                r.at -= 1  # no parent: what follows are sections
        while r.peek()[1] != "end" and r.peek() != ("session", "bare"):
            section = r.take()
            if section == "description":
                s["description"] = r.take()
            elif section == "options":
                s["options"] |= r.options()
            elif section == "theories":
                s["theories"] += _theories(r)
            elif section in LISTS:
                s[section] += r.names()
        out.append(s)
    return out


def root_sessions(text: str | Column) -> Column:
    """Array of sessions of each session file, an Arrow-batched UDF."""

    @F.pandas_udf(SESSIONS)
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([parse_root(x) for x in t], dtype=object)

    return run(text)


def sessions(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per session: ``entry`` (the file's folder) and its fields."""
    from stepforge.functions.text import parent_name

    found = files.select(parent_name(path).alias("entry"), F.explode(root_sessions(text)).alias("s"))
    return found.select("entry", "s.*")
