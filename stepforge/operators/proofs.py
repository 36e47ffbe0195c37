"""Ordered operators over the steps of a proof (or the turns of a dialogue)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(steps: DataFrame, group: Sequence[str], order: str, state: str, tactic: str, place: Sequence[str] = ()) -> DataFrame:
    """Adjacent states of one group: ``state_before``, the later step's ``tactic``, ``state_after``.

    place: columns of the later step that come along, as the place of its tactic.
    """
    w = Window.partitionBy(*group).orderBy(order)
    later = {"state_after": F.lead(state).over(w), "tactic": F.lead(tactic).over(w), "__last": F.lead(order).over(w).isNull()}
    out = steps.withColumns(later | {c: F.lead(c).over(w) for c in place})
    return out.where("not __last").select(*group, *place, order, F.col(state).alias("state_before"), "tactic", "state_after")


def prefixes(steps: DataFrame, group: Sequence[str], order: str, text: str, sep: str = "") -> DataFrame:
    """Adds ``prefix`` (texts up to this step) and ``continuation`` (texts after it, '' at the end).

    The texts of a group are gathered once; each step cuts its parts out by
    how many texts (NULL ones don't count) stand up to it.
    """
    w = Window.partitionBy(*group).orderBy(order)
    every = F.collect_list(text).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto = F.count(text).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    out = steps.withColumns({"__every": every, "__upto": upto})
    part = lambda start, n: F.array_join(F.slice("__every", start, n), sep)
    cut = {"prefix": part(F.lit(1), F.col("__upto")), "continuation": part(F.col("__upto") + 1, F.size("__every"))}
    return out.withColumns(cut).drop("__every", "__upto")


def slices(steps: DataFrame, text: str = "text", offset: str = "offset", start: str = "proof_start", end: str = "proof_end", scope: str = "proof") -> DataFrame:
    """``prefix`` and ``continuation`` cut out of a source text at a caret offset.

    scope 'file' lets the prefix begin at the start of the file. Outside any
    proof (NULL start) the prefix begins at the file's start and nothing follows.
    """
    if scope not in ("proof", "file"):
        raise ValueError("scope is 'proof' or 'file'")
    first = F.coalesce(F.col(start), F.lit(0)) if scope == "proof" else F.lit(0)
    cut = lambda a, b: F.substr(F.col(text), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    last = F.coalesce(F.col(end), F.col(offset))
    return steps.withColumns({"prefix": cut(first, F.col(offset)), "continuation": cut(F.col(offset), last)})


def in_proof(steps: DataFrame) -> DataFrame:
    return steps.where("in_proof")


def finished(steps: DataFrame) -> DataFrame:
    """Steps that end their proof: inside one, with nothing to follow."""
    return steps.where(F.col("in_proof") & (F.col("continuation") == ""))


def fold(steps: DataFrame, group: Sequence[str], order: str, bad: Column) -> DataFrame:
    """Per group: steps, last place, and whether any step is ``bad``."""
    return steps.groupBy(*group).agg(F.count(F.lit(1)).alias("n_steps"), F.max(order).alias("last_step"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("is_tainted"))


def untainted(steps: DataFrame, group: Sequence[str], bad: Column) -> DataFrame:
    """Steps of groups without any ``bad`` step (unfinished or abandoned proofs, error states)."""
    return steps.join(steps.where(bad).select(*group).distinct(), list(group), "left_anti")


def depth(steps: DataFrame, group: Sequence[str], order: str, opens: Column, closes: Column) -> DataFrame:
    """Adds ``depth``: openings less closings up to and with this step (no nesting rules)."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("depth", F.sum(opens.cast("int") - closes.cast("int")).over(w))


def alignment(steps: DataFrame, group: Sequence[str], order: str, before: str, after: str) -> DataFrame:
    """One row: share of adjacent transitions where one's end is the other's start, in percent."""
    w = Window.partitionBy(*group).orderBy(order)
    pairs = steps.withColumn("__next", F.lead(before).over(w)).withColumn("__has", F.lead(order).over(w).isNotNull()).where("__has")
    ok = F.count(F.when(F.col(after).eqNullSafe(F.col("__next")), 1))
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(100.0 * ok / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("alignment_pct"))
