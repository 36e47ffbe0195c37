"""Choosing files: patterns, entry lists, shards, limits, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys that boundaries are chosen from, and the number of ranges.
SAMPLE, RANGES = 10_000, 256


def include(df: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Rows whose path matches somewhere (a search, not a full match)."""
    return df.where(F.col(path).rlike(pattern))


def of_entries(df: DataFrame, entries: DataFrame, key: str = "entry") -> DataFrame:
    return df.join(entries.select(key).distinct(), key, "left_semi")


def not_done(df: DataFrame, checkpoint: DataFrame, key: str = "file") -> DataFrame:
    """Rows whose file no checkpoint row names."""
    return df.join(checkpoint.select(key).distinct(), key, "left_anti")


def first_n(df: DataFrame, n: int, order: str = "path") -> DataFrame:
    return df.orderBy(order).limit(n)


def with_ordinal(df: DataFrame, order: str, out: str = "ordinal") -> DataFrame:
    """0-based place of each row in the order of a unique, comparable column; NULL comes first.

    Places are taken in two levels, so no task sorts all rows: ranges between
    boundaries from a bounded sample (its quality only moves the load, not the
    result), rows before each range, and the place within it.
    """
    sampled = df.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(SAMPLE)
    keys = sorted(r[0] for r in sampled.collect())  # at most SAMPLE rows
    bounds = sorted({keys[i * len(keys) // RANGES] for i in range(1, RANGES)}) if len(keys) > RANGES else []
    if not bounds:
        return df.withColumn(out, (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))
    listed = F.array(*map(F.lit, bounds))
    part = F.when(F.col(order).isNull(), 0).otherwise(F.size(F.filter(listed, lambda b: b <= F.col(order))))
    ranged = df.withColumn("__range", part)
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return ranged.withColumn("__within", within).join(starts, "__range").withColumn(out, F.col("__start") + F.col("__within")).drop("__range", "__start", "__within")


def shard(df: DataFrame, index: int, of: int, order: str = "path") -> DataFrame:
    """Every ``of``-th row by ordinal: disjoint shards that together are everything."""
    if not 0 <= index < of:
        raise ValueError("index must be below the number of shards")
    return with_ordinal(df, order, "__ordinal").where(F.col("__ordinal") % of == index).drop("__ordinal")
