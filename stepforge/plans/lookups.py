"""Queries: parent lookups and generic equi-joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.operators.lookup import chains
from stepforge.sources.tables import table


def lookup_parent_chain(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    links = nation.select(F.col("n_name").alias("session"), F.col("n_regionkey").alias("k")).join(region, F.col("k") == F.col("r_regionkey"))
    links = links.select("session", F.col("r_name").alias("parent"))
    top = region.select(F.col("r_name").alias("session"), F.lit("HOL").alias("parent"))
    return chains(links.union(top), "session", "parent", 8)


def parent_counts(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = customer.select("c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n_customers"))


def state_join_source(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


QUERIES = {f.__name__: f for f in (lookup_parent_chain, parent_counts, state_join_source)}
ORACLE_SQL = {
    "lookup_parent_chain": """SELECT n_name AS session, 'HOL' AS root, CAST(2 AS INTEGER) AS depth FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, 'HOL', 1 FROM region""",
    "parent_counts": "SELECT n_regionkey, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey",
    "state_join_source": """SELECT o_orderstatus, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus""",
}
