"""Queries: paths and captured panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.functions.panel import panel_parse, panel_text
from stepforge.functions.text import parent_name
from stepforge.operators import select
from stepforge.sources.tables import table


def _pages(spark, sf_dir, *columns):
    return table(spark, sf_dir, "pages").select(*columns)


def path_parent(spark, sf_dir):
    return _pages(spark, sf_dir, "page_id", parent_name("url").alias("entry"))


def include_regex(spark, sf_dir):
    return select.include(_pages(spark, sf_dir, "page_id", "url"), r"/en/\d+", "url")


def empty_payload(spark, sf_dir):
    html = F.when(F.col("page_id") % 5 == 0, F.lit(None)).otherwise(F.col("html"))
    return _pages(spark, sf_dir, "page_id", F.length(F.coalesce(html, F.lit(""))).alias("n_html"))


def panel_texts(spark, sf_dir):
    text = panel_text("html")
    return _pages(spark, sf_dir, "page_id", "html").select("page_id", F.length("html").alias("n_html"), text.alias("text")).select("page_id", "n_html", F.length("text").alias("n_text"), F.md5("text").alias("text_md5"))


def panel_spans(spark, sf_dir):
    parsed = _pages(spark, sf_dir, "page_id", panel_parse("html").alias("p"))
    return parsed.select("page_id", F.explode("p.spans").alias("s")).select("page_id", "s.start", "s.end", "s.kind")


QUERIES = {f.__name__: f for f in (path_parent, include_regex, empty_payload, panel_texts, panel_spans)}
ORACLE_SQL = {
    "path_parent": "SELECT page_id, coalesce(p[-2], '') AS entry FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda s: s NOT IN ('', '.')) AS p FROM pages)",
    "include_regex": "SELECT page_id, url FROM pages WHERE regexp_matches(url, '/en/\\d+')",
    "empty_payload": "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 0 ELSE length(html) END AS n_html FROM pages",
}
