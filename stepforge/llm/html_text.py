"""HTML extraction with consensus host paths (operator 1).

Pass 1 scores the containers of every page and votes, per host, on generalised
tag-class paths. Pass 2 extracts each page again from the containers on its
host's winning path; a page without that path uses its own best container.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import Scratch

#: What starts markup: a comment, a tag with its name, or another declaration.
_START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
#: In a tag: its end, or a value in quotes.
_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
#: Elements skipped up to their end tags, whatever stands between; without an end tag, these two take the rest.
RAW = frozenset("script style noscript template svg iframe object math".split())
RAW_TO_END = frozenset(("script", "style"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text, and those that are left out unless inside an article.
DROPPED = frozenset("nav aside footer form button select option dialog head title menu textarea canvas audio video map".split())
DROPPED_OUTSIDE = frozenset(("header", "figcaption", "label"))
#: Parts of class or id names that mark boilerplate, those that do outside articles alone, and ARIA roles that do.
_NOISE = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|side-?bar|widget|menu|nav|navbar|navigation|breadcrumbs?"
    r"|comments?|commentlist|replies|reply|disqus|foot|footer|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|skip|hidden|copyright)(?:$|[-_\s])",
    re.I,
)
_NOISE_OUTSIDE = re.compile(r"(?:^|[-_\s])(?:header|masthead)(?:$|[-_\s])", re.I)
_DISCUSSION = re.compile(r"(?:^|[-_\s])discussion(?:$|[-_\s])", re.I)
#: Names of an article's own head, wherever it stands.
_ARTICLE_HEAD = re.compile(r"(?:^|(?<=[-_\s]))(?:article|entry|post|story|section|content)[-_]+header(?=$|[-_\s])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks that are parts of a container rather than one.
PARTS = HEADINGS | {"p", "li", "blockquote", "pre", "td", "dd", "dt"}
#: What an opening tag closes when it is still open: paragraphs and list or table parts.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Blocks with fewer characters count a little only, so lists of links don't outweigh paragraphs.
SHORT = 25


class _Node:
    """An open or closed element; parent, block and container are the nearest blocks above it (block and container: or itself)."""

    __slots__ = ("tag", "path", "noise", "article", "score", "parent", "block", "container", "at", "key", "inside")

    def __init__(self, tag, path, noise, article, above, at):
        self.tag, self.path, self.noise, self.article, self.score, self.inside = tag, path, noise, article, 0.0, False
        self.parent = above and above.block
        if tag in INLINE:
            self.block, self.container, self.at = above.block, above.container, above.at
            self.key = (above.at, tag)
        else:
            self.block, self.at, self.key = self, at, tag
            self.container = self if tag not in PARTS else above.container


def _path(above: str, tag: str, names: str) -> str:
    """A digest of the path from the root: each step a tag with its class names in order, runs of digits as ``#``."""
    step = ".".join([tag, *sorted({re.sub(r"\d+", "#", n.lower()) for n in names.split()})])
    return hashlib.blake2b(f"{above}/{step}".encode(), digest_size=12).hexdigest()


def _is_noise(tag: str, attributes: dict[str, str], article: bool) -> bool:
    if tag in DROPPED:
        return True
    named = _ARTICLE_HEAD.sub("", own := f"{attributes.get('class', '')} {attributes.get('id', '')}") if attributes else (own := "")
    if tag in DROPPED_OUTSIDE and not article and named == own:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in _ROLES or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "article", "main") or own == " ":
        return False
    talk = not (article and (tag == "section" or tag in HEADINGS))  # a section on results is no talk of readers
    return bool(_NOISE.search(named) or not article and _NOISE_OUTSIDE.search(named) or talk and _DISCUSSION.search(named))


def _tags(html: str) -> Iterator[tuple[str, bool, str, str]]:
    """``text before, whether an end tag, name, attributes`` of each tag, then the rest with an empty name.

    Reads every character a bounded number of times, whatever the page. A quote
    that is never closed is an ordinary character; a tag, comment, script or
    style that never ends takes the rest, as in browsers.
    """
    at, since, end, absent, closers = 0, 0, len(html), set(), {}
    held: list[str] = []

    def find(what: str, start: int) -> int:
        """Where ``what`` ends from ``start`` on, or -1; what was missing once isn't looked for again."""
        if what in absent:
            return -1
        i = html.find(what, start)
        if i < 0:
            absent.add(what)
        return i + len(what) if i >= 0 else -1

    def tag_end(start: int) -> int:
        while m := _STOP.search(html, start):
            if m[1] is None:
                return m.end()
            start = max(find(m[1], m.end()), m.end())
        return -1

    while at < end and (m := _START.search(html, at)):
        held.append(html[since : m.start()])
        if m[3] is None:
            at = since = find("-->", m.end() - 2) if m[1] else find(">", m.end())
            if at < 0:
                at = since = end
            continue
        at = since = tag_end(m.end())
        if at < 0:
            at = since = end
            break
        name, attributes = m[3].lower(), html[m.end() : at - 1]
        if name in RAW and not m[2]:
            if not attributes.endswith("/") and name not in absent:
                closers.setdefault(name, re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I))
                close = closers[name].search(html, at)
                if close:
                    at = since = close.end()
                else:
                    absent.add(name)
                    if name in RAW_TO_END:
                        at = since = end
            continue
        yield "".join(held), bool(m[2]), name, attributes
        held.clear()
    held.append(html[since:])
    yield "".join(held), False, "", ""


def parse(html: str) -> tuple[list[tuple[_Node, str]], list[_Node]]:
    """The text runs of a page with the blocks they stand in, and all blocks, parents first.

    A run is the text of one block; boilerplate gives none. Unclosed, crossed
    and surplus tags are repaired like a browser would in the simple cases.
    """
    stack = [_Node("", "", False, False, None, 0)]
    stack[0].container = stack[0]
    nodes, runs, words, opened = [stack[0]], [], [], Counter()

    def flush() -> None:
        if words:
            text = " ".join(_html.unescape("".join(words)).split())
            words.clear()
            if text:
                runs.append((stack[-1].block, text))

    def cut(i: int) -> None:
        opened.subtract(n.key for n in stack[i:])
        del stack[i:]

    for text, ends, tag, rest in _tags(html):
        if text and not stack[-1].noise:
            words.append(text)
        if tag not in INLINE:
            flush()
        if not tag:
            break
        if ends:
            if opened[(stack[-1].at, tag) if tag in INLINE else tag] > 0:  # an inline end tag doesn't close a block
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            block = stack[-1].block
            if block.tag == "p" or block.tag in _CLOSES.get(tag, ()):
                cut(block.at)
        top = stack[-1]
        attributes: dict[str, str] = {}
        if rest.strip(" /"):
            for a in _ATTRIBUTE.finditer(rest):
                attributes.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        article = top.article or tag in ("article", "main")
        noise = top.noise or _is_noise(tag, attributes, top.article)
        inline = tag in INLINE
        node = _Node(tag, top.path if inline else _path(top.path, tag, attributes.get("class", "")), noise, article, top, len(stack))
        if not inline:
            nodes.append(node)
            if rest.endswith("/"):
                continue
        stack.append(node)
        opened[node.key] += 1
    return runs, nodes


def _score(runs) -> None:
    """Each block gives the container it stands in its worth, the next one above half of it."""
    for block, text in runs:
        worth = 1 + text.count(",") * 0.2 + min(len(text) / 100, 10) if len(text) >= SHORT else len(text) / 1000
        inner = block.container
        inner.score += worth
        if inner.parent:
            inner.parent.container.score += worth / 2


def _best(nodes) -> _Node:
    return max(nodes, key=lambda n: n.score)


def page_votes(html: str) -> str | None:
    """The path of the page's best container, as a digest; the first one wins a tie."""
    runs, nodes = parse(html)
    _score(runs)
    best = _best(nodes)
    return best.path if best.score > 0 else None


def page_text(html: str, path: str | None) -> str:
    """The text in the containers on ``path``, or in the best one of a page without it; with the h1 beside, if they hold none."""
    runs, nodes = parse(html)
    if not runs:
        return ""

    def within(chosen) -> list[int]:
        for n in nodes:
            n.inside = chosen(n) or (n.parent is not None and n.parent.inside)
        return [i for i, (block, _) in enumerate(runs) if block.inside]

    found = within(lambda n: n.path == path) if path is not None else []
    if not found:
        _score(runs)
        best = _best(nodes)
        found = within(lambda n: n is best)
    if all(runs[i][0].tag != "h1" for i in found):
        beside = {id(n.parent) for n in nodes if n.inside and n.parent is not None and not n.parent.inside}
        found = [i for i, (block, _) in enumerate(runs[: found[0]]) if block.tag == "h1" and id(block.parent) in beside] + found
    return " ".join(runs[i][1] for i in found)


def host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][-A-Za-z0-9+.]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path``: the path that most pages of a host vote for; the smaller string wins a tie.

    Votes are counted per task before the shuffle, and per (host, path) before
    they meet by host, so a host with a third of all pages is one row a task.
    """

    def votes(batches):
        for b in batches:
            n = Counter((h, p) for h, x in zip(b.host, b.html) if (p := page_votes(x)) is not None)
            yield pd.DataFrame([(h, p, k) for (h, p), k in n.items()], columns=["host", "path", "n"])

    cast = pages.select(host(url).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html")).mapInPandas(votes, "host string, path string, n long")
    counted = cast.groupBy("host", "path").agg(F.sum("n").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "path"))
    return counted.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("path"))


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", scratch: Scratch | None = None, broadcast_hosts: int = 50_000) -> DataFrame:
    """``pages`` with a string column ``out``: the main text, empty if there is none.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined in page order by one space; nothing is cut off.
    NULL or empty html gives an empty text. Pages without a host share the
    empty host. A page takes time in proportion to its length, however broken it
    is. A column named ``out`` is replaced; repeated rows and all other
    columns stay. An empty table gives an empty table.

    The table of winning paths is written to the shared folder and counted: up
    to ``broadcast_hosts`` rows (each at most a few hundred bytes) it is
    broadcast, above that the join shuffles by host, and Spark splits hot hosts.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    paths = scratch.write(host_paths(pages, url, html)).select(F.col("host").alias("__host"), F.col("path").alias("__path"))
    if paths.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        paths = F.broadcast(paths)

    @F.pandas_udf("string")
    def text(content: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([page_text(x or "", p) for x, p in zip(content, path)], dtype=object)

    joined = pages.withColumn("__host", host(url)).join(paths, "__host", "left")
    return joined.withColumn(out, text(F.col(html), F.col("__path"))).drop("__host", "__path")
