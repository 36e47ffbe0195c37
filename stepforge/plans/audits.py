"""Queries: semi and anti joins, leakage, coverage, verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.functions.text import percent
from stepforge.operators import audit, select
from stepforge.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang")


def semi_entries(spark, sf_dir):
    return select.of_entries(_docs(spark, sf_dir), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


def anti_missing(spark, sf_dir):
    return audit.missing(_docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")


def anti_resume(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), "o_orderstatus")
    done = table(spark, sf_dir, "lineitem").where("l_shipdate < '1997-01-01'").select(F.col("l_orderkey").alias("file"))
    return select.not_done(orders, done)


def leak_exact(spark, sf_dir):
    held = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return audit.present(table(spark, sf_dir, "documents").select("doc_id"), held, "doc_id")


def leak_contains(spark, sf_dir):
    needles = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    found = audit.containing(table(spark, sf_dir, "documents").select("doc_id", "text"), needles, "text", "needle")
    return found.select("doc_id", "item_id")


def coverage_report(spark, sf_dir):
    have = table(spark, sf_dir, "documents").where("source <> 'src0'").select("doc_id")
    return audit.coverage(have, table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


def merge_verdict(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    leaked = audit.present(docs, table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return audit.verdict(docs.select("source").distinct(), leaked)


def empty_groups(spark, sf_dir):
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return audit.empty_groups(expected, table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), "k")


def exemplars(spark, sf_dir):
    return audit.exemplars(table(spark, sf_dir, "documents"), "source", 8)


def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(
        F.count_distinct("source").alias("n_sources"), F.count_distinct("lang").alias("n_langs"), F.count(F.lit(1)).alias("n_docs")
    )


def output_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"), (F.sum("n_chars") == 0).alias("is_empty"))


def label_coverage(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    both = docs.join(labels.withColumn("l", F.lit(1)), "doc_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n_docs"), F.count("l").alias("n_labelled"), percent(F.count("l"), F.count(F.lit(1))).alias("pct"))


QUERIES = {
    f.__name__: f
    for f in (
        semi_entries, anti_missing, anti_resume, leak_exact, leak_contains, coverage_report, merge_verdict,
        empty_groups, exemplars, distinct_counts, output_stats, label_coverage,
    )
}
ORACLE_SQL = {
    "semi_entries": "SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "anti_missing": "SELECT doc_id, source, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "anti_resume": """SELECT o_orderkey AS file, o_orderstatus FROM orders WHERE NOT EXISTS
  (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < TIMESTAMP '1997-01-01')""",
    "leak_exact": "SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "leak_contains": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "coverage_report": """WITH h AS (SELECT DISTINCT doc_id FROM documents WHERE source <> 'src0'), w AS (SELECT DISTINCT doc_id FROM labels),
  n AS (SELECT (SELECT count(*) FROM h) AS n_entries, (SELECT count(*) FROM w) AS n_wanted, (SELECT count(*) FROM h JOIN w USING (doc_id)) AS n_both)
SELECT *, round(100.0 * n_entries / greatest(n_wanted, 1), 1) AS coverage_ref_pct, round(100.0 * n_both / greatest(n_wanted, 1), 1) AS coverage_true_pct FROM n""",
    "merge_verdict": """SELECT CAST(CASE WHEN (SELECT count(DISTINCT source) FROM documents) = 0 THEN 2 WHEN k > 0 THEN 1 ELSE 0 END AS INTEGER) AS status, k AS n_leaked
FROM (SELECT count(*) AS k FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)))""",
    "empty_groups": "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "exemplars": "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL ORDER BY source LIMIT 8",
    "distinct_counts": "SELECT count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, count(*) AS n_docs FROM documents",
    "output_stats": "SELECT source, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars, sum(n_chars) = 0 AS is_empty FROM documents GROUP BY source",
    "label_coverage": """SELECT count(*) AS n_docs, count(l.doc_id) AS n_labelled, round(100.0 * count(l.doc_id) / greatest(count(*), 1), 1) AS pct
FROM documents d LEFT JOIN labels l USING (doc_id)""",
}
