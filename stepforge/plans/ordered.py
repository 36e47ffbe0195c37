"""Queries: ordered operators, with dialogues in place of proofs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.operators import proofs
from stepforge.sources.tables import table

G = ["conv_id"]


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def transitions_lead(spark, sf_dir):
    out = proofs.transitions(_turns(spark, sf_dir), G, "turn", "text", "role")
    return out.select("conv_id", "turn", "tactic", F.length("state_before").alias("len_before"), F.length("state_after").alias("len_after"), F.md5("state_after").alias("after_md5"))


def prefix_concat(spark, sf_dir):
    out = proofs.prefixes(_turns(spark, sf_dir), G, "turn", "text", "\n")
    return out.select("conv_id", "turn", F.length("prefix").alias("prefix_len"), F.md5("prefix").alias("prefix_md5"))


def continuation_concat(spark, sf_dir):
    out = proofs.prefixes(_turns(spark, sf_dir), G, "turn", "text", "\n")
    return out.select("conv_id", "turn", F.length("continuation").alias("continuation_len"), F.md5("continuation").alias("continuation_md5"))


def _flagged(spark, sf_dir):
    return proofs.prefixes(_turns(spark, sf_dir), G, "turn", "text").withColumn("in_proof", F.col("role") != "system")


def proof_finished(spark, sf_dir):
    return proofs.finished(_flagged(spark, sf_dir)).select("conv_id", "turn", "role")


def in_proof_filter(spark, sf_dir):
    return proofs.in_proof(_turns(spark, sf_dir).withColumn("in_proof", F.col("role") != "system")).select("conv_id", "turn", "role")


def proof_fold(spark, sf_dir):
    return proofs.fold(_turns(spark, sf_dir), G, "turn", F.col("role") == "system")


def tainted_proof_filter(spark, sf_dir):
    return proofs.untainted(_turns(spark, sf_dir), G, F.col("role") == "system").select("conv_id", "turn", "role")


def alignment_pct(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    steps = steps.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("state_before"), F.max("l_returnflag").alias("state_after"))
    return proofs.alignment(steps, ["l_orderkey"], "l_linenumber", "state_before", "state_after")


def proof_depth(spark, sf_dir):
    out = proofs.depth(_turns(spark, sf_dir), G, "turn", F.col("role") == "user", F.col("role") == "assistant")
    return out.select("conv_id", "turn", F.col("depth").cast("long").alias("depth"))


QUERIES = {
    f.__name__: f
    for f in (
        transitions_lead, prefix_concat, continuation_concat, proof_finished, in_proof_filter, proof_fold,
        tainted_proof_filter, alignment_pct, proof_depth,
    )
}
_W = "PARTITION BY conv_id ORDER BY turn"
ORACLE_SQL = {
    "transitions_lead": f"""SELECT conv_id, turn, tactic, length(text) AS len_before, length(state_after) AS len_after, md5(state_after) AS after_md5 FROM
  (SELECT conv_id, turn, text, lead(role) OVER ({_W}) AS tactic, lead(text) OVER ({_W}) AS state_after, lead(turn) OVER ({_W}) AS nxt FROM conversations) WHERE nxt IS NOT NULL""",
    "prefix_concat": f"""SELECT conv_id, turn, length(p) AS prefix_len, md5(p) AS prefix_md5 FROM
  (SELECT conv_id, turn, string_agg(text, chr(10)) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS p FROM conversations)""",
    "continuation_concat": f"""SELECT conv_id, turn, length(p) AS continuation_len, md5(p) AS continuation_md5 FROM
  (SELECT conv_id, turn, coalesce(string_agg(text, chr(10)) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS p FROM conversations)""",
    "proof_finished": f"""SELECT conv_id, turn, role FROM (SELECT *, coalesce(string_agg(text, '') OVER
  ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS p FROM conversations) WHERE p = '' AND role <> 'system'""",
    "in_proof_filter": "SELECT conv_id, turn, role FROM conversations WHERE role <> 'system'",
    "proof_fold": "SELECT conv_id, count(*) AS n_steps, max(turn) AS last_step, coalesce(bool_or(role = 'system'), false) AS is_tainted FROM conversations GROUP BY conv_id",
    "tainted_proof_filter": """SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN
  (SELECT conv_id FROM conversations WHERE role = 'system')""",
    "alignment_pct": """WITH s AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS b, max(l_returnflag) AS a FROM lineitem GROUP BY 1, 2),
  p AS (SELECT a, lead(b) OVER w AS nb, lead(l_linenumber) OVER w AS nn FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT count(*) AS n_pairs, round(100.0 * count(CASE WHEN a IS NOT DISTINCT FROM nb THEN 1 END) / greatest(count(*), 1), 1) AS alignment_pct FROM p WHERE nn IS NOT NULL""",
    "proof_depth": f"""SELECT conv_id, turn, CAST(sum(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth
  FROM conversations""",
}
