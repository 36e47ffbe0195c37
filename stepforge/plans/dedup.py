"""Queries: first-wins deduplication and its counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.operators.dedup import duplicate_counts, first_wins
from stepforge.sources.tables import table


def dedup_first_wins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    kept = first_wins(docs, ["text"], ["source", "doc_id"])
    return kept.select("doc_id", "source", "lang", F.length("text").alias("text_len"))


def dup_counts(spark, sf_dir):
    return duplicate_counts(table(spark, sf_dir, "documents"), ["text"])


def kept_per_shard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = first_wins(docs, ["text"], ["source", "doc_id"])
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n_kept"))


QUERIES = {"dedup_first_wins": dedup_first_wins, "dup_counts": dup_counts, "kept_per_shard": kept_per_shard}

_RANKED = """SELECT doc_id, source, lang, text,
  row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS rn FROM documents"""
ORACLE_SQL = {
    "dedup_first_wins": f"SELECT doc_id, source, lang, length(text) AS text_len FROM ({_RANKED}) WHERE rn = 1",
    "dup_counts": """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_records, count(*) AS n_distinct,
  CAST(coalesce(sum(n), 0) - count(*) AS BIGINT) AS n_duplicates
  FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)""",
    "kept_per_shard": f"SELECT source, count(*) AS n_kept FROM ({_RANKED}) WHERE rn = 1 GROUP BY source",
}
