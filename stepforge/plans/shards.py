"""Queries: shards, entries, set operations, limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepforge.operators import select
from stepforge.sources.tables import table

N_SHARDS = 12


def _sharded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return docs.withColumn("shard", F.concat(F.lit("shard_"), (F.col("doc_id") % N_SHARDS).cast("string")))


def shard_order_lexicographic(spark, sf_dir):
    per = _sharded(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return per.withColumn("shard_rank", F.row_number().over(Window.orderBy("shard")))


def shard_index_assign(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    placed = select.with_ordinal(docs, "doc_id")
    return placed.select("doc_id", "ordinal", (F.col("ordinal") % 32).alias("shard_no"))


def shard_predicate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return select.shard(docs, 3, 8, "doc_id")


def limit_first_n(spark, sf_dir):
    return select.first_n(table(spark, sf_dir, "pages").select("page_id", "url"), 50, "page_id")


def sample_records(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").orderBy("conv_id", "turn").limit(20)


def union_shards(spark, sf_dir):
    docs = _sharded(spark, sf_dir).select("shard", "doc_id", "lang")
    halves = docs.where("shard < 'shard_5'"), docs.where("shard >= 'shard_5'").drop("lang")
    return halves[0].unionByName(halves[1], allowMissingColumns=True)


def distinct_entries(spark, sf_dir):
    name = F.trim(F.col("source"))
    return table(spark, sf_dir, "documents").select(name.alias("entry")).where("entry <> ''").distinct()


def except_missing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id"))


def intersect_held(spark, sf_dir):
    held = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").intersect(held)


QUERIES = {
    f.__name__: f
    for f in (
        shard_order_lexicographic, shard_index_assign, shard_predicate, limit_first_n, sample_records,
        union_shards, distinct_entries, except_missing, intersect_held,
    )
}
_SHARDED = f"(SELECT *, 'shard_' || CAST(doc_id % {N_SHARDS} AS VARCHAR) AS shard FROM documents)"
ORACLE_SQL = {
    "shard_order_lexicographic": f"""SELECT shard, count(*) AS n_docs, min(doc_id) AS first_doc,
  CAST(row_number() OVER (ORDER BY shard) AS INTEGER) AS shard_rank FROM {_SHARDED} GROUP BY shard""",
    "shard_index_assign": """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal,
  (row_number() OVER (ORDER BY doc_id) - 1) % 32 AS shard_no FROM documents""",
    "shard_predicate": """SELECT doc_id, source FROM
  (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE n % 8 = 3""",
    "limit_first_n": "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 50",
    "sample_records": "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 20",
    "union_shards": f"""SELECT shard, doc_id, lang FROM {_SHARDED} WHERE shard < 'shard_5'
  UNION ALL SELECT shard, doc_id, NULL FROM {_SHARDED} WHERE shard >= 'shard_5'""",
    "distinct_entries": "SELECT DISTINCT trim(source) AS entry FROM documents WHERE trim(source) <> ''",
    "except_missing": "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels",
    "intersect_held": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1",
}
