"""Correlating events: as-of, carry-forward, sessions, request and response."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, value: Sequence[str], tolerance: str | None = None) -> DataFrame:
    """Each left row with the values of the last right row at or before it, and its time ``matched_ts``.

    One union and one window per key instead of a range join: rows of both
    sides are sorted together, and the last right row is carried forward. Of
    right rows at one time the one with the largest values counts. tolerance:
    an interval ('5 minutes'); an older match counts as none (NULLs).
    """
    keep = [c for c in left.columns if c not in (*by, ts)]
    l = left.select(*by, ts, F.struct(*keep).alias("__l"), F.lit(None).alias("__r"), F.lit(1).alias("__side"))  # noqa: E741
    r = right.select(*by, ts, F.lit(None).alias("__l"), F.struct(F.col(ts).alias("matched_ts"), *value).alias("__r"), F.lit(0).alias("__side"))
    l = l.withColumn("__r", F.lit(None).cast(r.schema["__r"].dataType))  # noqa: E741
    both = l.unionByName(r.withColumn("__l", F.lit(None).cast(l.schema["__l"].dataType)))
    w = Window.partitionBy(*by).orderBy(ts, "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    if tolerance is not None:
        out = out.withColumn("__m", F.when(F.col("__m.matched_ts") >= F.col(ts) - F.expr(f"interval {tolerance}"), F.col("__m")))
    return out.select(*by, ts, "__l.*", "__m.matched_ts", *[F.col(f"__m.{v}").alias(f"matched_{v}") for v in value])


def carry_forward(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Adds the last non-NULL ``value`` up to and with each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def sessions(df: DataFrame, by: Sequence[str], ts: str, gap: str, tie: str) -> DataFrame:
    """Adds ``session``, counted from 1 per key: a new one starts after a pause longer than ``gap``."""
    w = Window.partitionBy(*by).orderBy(ts, tie)
    start = F.coalesce(F.lag(ts).over(w) < F.col(ts) - F.expr(f"interval {gap}"), F.lit(True))
    marked = df.withColumn("__new", start.cast("int"))
    return marked.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def responses(requests: DataFrame, replies: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """Requests with the replies of the same ``key`` no later than ``within``; reply columns get ``reply_``.

    Time is cut into buckets no shorter than ``within``: a reply lies in its
    request's bucket or the next one, so a busy key is compared bucket by
    bucket, not as a whole.
    """
    end = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {within}"))
    moved = 3_600_000_000 if "timestamp_ntz" in (dict(requests.dtypes)[ts], dict(replies.dtypes)[ts]) else 0  # by clock changes
    width = F.greatest(end * 1.1, F.lit(1.0)) + moved  # months differ in length
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / width)
    renamed = replies.select(F.col(key), *[F.col(c).alias(f"reply_{c}") for c in replies.columns if c != key])
    renamed = renamed.withColumn("__bucket", bucket(f"reply_{ts}"))
    asked = requests.withColumn("__bucket", F.explode(F.array(bucket(ts), bucket(ts) + 1)))
    lag = (F.col(f"reply_{ts}") >= F.col(ts)) & (F.col(f"reply_{ts}") <= F.col(ts) + F.expr(f"interval {within}"))
    return asked.join(renamed, [key, "__bucket"]).where(lag).drop("__bucket")


def last_per_stop(df: DataFrame, by: Sequence[str], ts: str, value: str) -> DataFrame:
    """Of several outputs for one stop, the last one in time."""
    return df.groupBy(*by).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))
