"""Queries: event correlation and JSON fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.operators import correlate
from stepforge.sources.jsonl import parse_lines
from stepforge.sources.tables import table


def _events(spark, sf_dir, *columns):
    return table(spark, sf_dir, "events").select(*columns)


def asof_last_error(spark, sf_dir):
    e = _events(spark, sf_dir, "event_id", "ts", "user_id", "event_type")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    errors = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    out = correlate.as_of(bought, errors, ["user_id"], "ts", ["error_id"])
    return out.where("matched_error_id is not null").select("event_id", "user_id", F.col("matched_error_id").alias("error_id"))


def carry_forward(spark, sf_dir):
    e = _events(spark, sf_dir, "event_id", "ts", "user_id", "event_type", "value")
    value = F.when(F.col("event_type") == "click", F.col("value"))
    return correlate.carry_forward(e, ["user_id"], ["ts", "event_id"], value, "last_click").select("event_id", "last_click")


def session_gap(spark, sf_dir):
    e = correlate.sessions(_events(spark, sf_dir, "event_id", "ts", "user_id"), ["user_id"], "ts", "1 day", "event_id")
    per = e.groupBy("user_id", F.col("session").cast("long").alias("session"))
    return per.agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))


def interval_pairs(spark, sf_dir):
    e = _events(spark, sf_dir, "event_id", "ts", "user_id", "event_type")
    ask, reply = (e.where(F.col("event_type") == t).select("user_id", "ts", "event_id") for t in ("click", "purchase"))
    return correlate.responses(ask, reply, "user_id", "ts", "2 hours").select("user_id", "event_id", "reply_event_id")


def last_per_stop(spark, sf_dir):
    e = _events(spark, sf_dir, "event_id", "ts", "user_id", "event_type")
    return correlate.last_per_stop(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


def json_field(spark, sf_dir):
    return _events(spark, sf_dir, "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def json_missing_null(spark, sf_dir):
    return _events(spark, sf_dir, "event_id", F.get_json_object("props", "$.missing").isNull().alias("is_null"))


def bad_rows_dropped(spark, sf_dir):
    broken = F.when(F.col("event_id") % 7 == 0, F.substr("props", F.lit(1), F.lit(3))).when(F.col("event_id") % 11 == 0, F.lit("  ")).otherwise(F.col("props"))
    e = _events(spark, sf_dir, "event_id", broken.alias("raw"))
    good, _ = parse_lines(e, "k long", "raw")
    return good.select("event_id", F.col("rec.k").alias("k"))


def message_counts(spark, sf_dir):
    return _events(spark, sf_dir, "event_type", "props").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_messages"), F.sum(F.length("props")).alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        asof_last_error, carry_forward, session_gap, interval_pairs, last_per_stop, json_field, json_missing_null, bad_rows_dropped, message_counts,
    )
}
ORACLE_SQL = {
    "asof_last_error": """SELECT p.event_id, p.user_id, e.event_id AS error_id
  FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'error') e
  ON p.user_id = e.user_id AND p.ts >= e.ts""",
    "carry_forward": """SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_click FROM events""",
    "session_gap": """WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w >= ts - INTERVAL 1 DAY THEN 0 ELSE 1 END AS is_new
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM m)
SELECT user_id, session, count(*) AS n_events, min(event_id) AS first_event FROM s GROUP BY user_id, session""",
    "interval_pairs": """SELECT a.user_id, a.event_id, b.event_id AS reply_event_id FROM events a JOIN events b ON a.user_id = b.user_id
  AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR""",
    "last_per_stop": "SELECT user_id, event_type, max_by(event_id, ts) AS event_id FROM events GROUP BY user_id, event_type",
    "json_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "json_missing_null": "SELECT event_id, json_extract_string(props, '$.missing') IS NULL AS is_null FROM events",
    "bad_rows_dropped": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0",
    "message_counts": "SELECT event_type, count(*) AS n_messages, CAST(sum(length(props)) AS BIGINT) AS n_chars FROM events GROUP BY event_type",
}
