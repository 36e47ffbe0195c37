"""Ordered, keyed deduplication and its counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """Keep, for each key, the row that comes first in ``order``.

    NULL key parts equal each other. The plan limits each group before the
    shuffle as well as after it, so duplicates shrink on the map side.
    ``dropDuplicates`` is no substitute: it ignores the order.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def duplicate_counts(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """One row: records, distinct keys and duplicates. NULL parts count as values."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_records"),
        F.count(F.lit(1)).alias("n_distinct"),
        (F.coalesce(F.sum("__n"), F.lit(0)) - F.count(F.lit(1))).alias("n_duplicates"),
    )
