"""Parent lookup over chains (session, parent session, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chains(sessions: DataFrame, key: str, parent: str, most: int = 64) -> DataFrame:
    """``key, root, depth``: the end of each chain of parents and its length.

    Each round doubles the distance looked ahead, so rounds grow with the
    logarithm of the longest chain, not with it. A parent that isn't listed
    ends a chain (it is the root). A chain longer than ``most``, or a cycle,
    raises an error when the result is computed.
    """
    own = sessions.select(F.col(key).alias("k"), F.col(parent).alias("up")).distinct()
    now = own.select("k", F.coalesce("up", "k").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("n"))
    reach = 1
    while reach < most:
        ahead = now.select(F.col("k").alias("up"), F.col("up").alias("far"), F.col("n").alias("more"))
        now = now.join(ahead, "up", "left").select(
            "k", F.coalesce("far", "up").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")
        )
        reach *= 2
    end = F.when(F.col("n") >= most, F.raise_error(F.lit("a chain of parents is too long or a cycle"))).otherwise(F.col("n"))
    return now.select(F.col("k").alias(key), F.col("up").alias("root"), end.cast("int").alias("depth"))
