"""The harvest plan: sources to stops, stops and captured panels to states and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.functions import segment
from stepforge.functions.panel import panel_text
from stepforge.operators import proofs, select


def choose_files(
    files: DataFrame, include: str | None = None, entries: DataFrame | None = None, shard: int | None = None,
    num_shards: int | None = None, done: DataFrame | None = None, limit: int | None = None,
) -> DataFrame:
    """Files to harvest: by pattern, entry list, shard, what is done already, and the first so many."""
    out = files if include is None else select.include(files, include)
    if entries is not None:
        out = select.of_entries(out.withColumn("entry", F.col("entry_ref")), entries).drop("entry")
    if num_shards is not None:
        out = select.shard(out, shard or 0, num_shards)
    if done is not None:
        out = select.not_done(out.withColumn("file", F.col("path")), done).drop("file")
    return out if limit is None else select.first_n(out, limit)


def mock_states(stops: DataFrame) -> DataFrame:
    """Deterministic goal displays in place of a prover's: '' where a proof ends, else as many subgoals as are open."""
    shown = F.concat(F.lit("proof (prove)\ngoal ("), F.greatest("depth", F.lit(1)).cast("string"), F.lit(" subgoals):\n 1. mock "), F.substr(F.md5(F.concat_ws(":", "file", "offset")), F.lit(1), F.lit(12)))
    return stops.withColumn("state", F.when(F.col("in_proof") & (F.col("continuation") != ""), shown).otherwise(F.lit("")))


def with_panels(stops: DataFrame, panels: DataFrame) -> DataFrame:
    """The captured HTML panel (``file, offset, content``) of each stop as text; stops without one show ''."""
    seen = panels.select("file", "offset", panel_text("content").alias("state"))
    return stops.join(seen, ["file", "offset"], "left").withColumn("state", F.coalesce("state", F.lit("")))


def state_rows(files: DataFrame, panels: DataFrame | None = None, mode: str = "commands", prefix_scope: str = "proof") -> DataFrame:
    """All stops of the files with prefix, state and continuation; panels None: mock states."""
    stops = segment.stops(files, mode=mode).withColumn("offset", F.col("end"))
    cut = proofs.slices(stops, scope=prefix_scope)
    found = mock_states(cut) if panels is None else with_panels(cut, panels)
    return found.select(
        "file", "line", "character", "offset", "command", "kind", "in_proof", "proof_id", "proof_start", "proof_end", "start", "end", "prefix", "state", "continuation",
    )


def transition_rows(states: DataFrame) -> DataFrame:
    """Adjacent counted states of each proof; the tactic is the later command's text, line and character are where it ends."""
    tactic = F.expr("right(prefix, `end` - start)")
    steps = segment.counted(states.withColumn("tactic", tactic)).select("file", "proof_id", "line", "character", "offset", "tactic", "state")
    out = proofs.transitions(steps, ["file", "proof_id"], "offset", "state", "tactic", ["line", "character"])
    return out.select("file", "line", "character", "proof_id", "offset", "tactic", "state_before", "state_after")
