"""Audits of a merged dataset: coverage, leakage, empty shards, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.functions.text import percent

#: A list of held-out texts up to this many rows is broadcast.
BROADCAST_NEEDLES = 1000


def missing(want: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows of ``want`` whose key ``have`` lacks."""
    return want.join(have, key, "left_anti")


def present(have: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``have`` that are held out."""
    return have.select(key).distinct().join(held, key, "left_semi")


def exemplars(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The first ``n`` distinct values of a column in code-point order."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(n)


def coverage(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """One row: entries had, wanted and both; ``coverage_ref_pct`` counts all entries had
    (so it can pass 100), ``coverage_true_pct`` only the wanted ones."""
    h, w = (d.select(key).where(F.col(key).isNotNull()).distinct() for d in (have, want))
    marks = h.withColumn("h", F.lit(1)).join(w.withColumn("w", F.lit(1)), key, "full")
    n = marks.agg(
        F.count("h").alias("n_entries"), F.count("w").alias("n_wanted"), F.count(F.when(F.col("h") + F.col("w") == 2, 1)).alias("n_both")
    )
    return n.withColumns(
        {"coverage_ref_pct": percent(F.col("n_entries"), F.col("n_wanted")), "coverage_true_pct": percent(F.col("n_both"), F.col("n_wanted"))}
    )


def empty_groups(expected: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Expected keys without any row."""
    return expected.select(key).distinct().join(have.select(key), key, "left_anti")


def verdict(n_shards: DataFrame, leaked: DataFrame) -> DataFrame:
    """One row ``status``: 2 without shards, 1 with leaked entries, else 0."""
    rows = n_shards.select(F.lit("s").alias("what")).union(leaked.select(F.lit("k")))
    n = rows.agg(F.count(F.when(F.col("what") == "s", 1)).alias("s"), F.count(F.when(F.col("what") == "k", 1)).alias("k"))
    return n.select(F.when(F.col("s") == 0, 2).when(F.col("k") > 0, 1).otherwise(0).alias("status"), F.col("k").alias("n_leaked"))


def containing(docs: DataFrame, needles: DataFrame, text: str, needle: str) -> DataFrame:
    """Pairs of rows where ``text`` contains ``needle``.

    A list of needles whose size is checked is broadcast. A longer one meets
    the texts by a word: between its first and last space a needle consists of
    whole words, and the longest of them must be a word of the text; needles
    without such a word still are compared with all texts, if they are few.
    """
    if needles.limit(BROADCAST_NEEDLES + 1).count() <= BROADCAST_NEEDLES:
        return docs.join(F.broadcast(needles), F.contains(text, needle))
    words = F.split(needle, " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    ranked = F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    keyed = needles.withColumn("__word", F.try_element_at(ranked, F.lit(1))["w"])
    anchored, rest = keyed.where("__word <> ''"), keyed.where("__word is null or __word = ''").drop("__word")
    if rest.limit(BROADCAST_NEEDLES + 1).count() > BROADCAST_NEEDLES:
        raise ValueError(f"more than {BROADCAST_NEEDLES} needles without an inner word")
    exploded = docs.withColumn("__word", F.explode(F.array_distinct(F.split(text, " "))))
    pairs = exploded.join(anchored, "__word").where(F.contains(text, needle)).drop("__word")
    return pairs.unionByName(docs.join(F.broadcast(rest), F.contains(text, needle)))
