"""Replaying captured message logs: batch first, then Structured Streaming.

A log row is ``ts, doc, direction, id, method, params``. Caret moves and panel
outputs of one document are interleaved by time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.operators import correlate

LOG = "ts timestamp, doc string, direction string, id long, method string, params string"
#: The protocol's method names.
STATE_INIT, STATE_OUTPUT, STATE_UPDATE, DYNAMIC_OUTPUT, CARET = (
    "PIDE/state_init", "PIDE/state_output", "PIDE/state_update", "PIDE/dynamic_output", "PIDE/caret_update",
)

#: The time of the state's caret where there is none.
NO_CARET = -1


def read_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A message log in JSON lines, as a table or as a stream of its files."""
    return (spark.readStream if stream else spark.read).schema(LOG).json(path)


def outputs(log: DataFrame, channel: str = STATE_OUTPUT) -> DataFrame:
    """``doc, ts, id, auto_update, content`` of one channel's messages."""
    p = F.from_json("params", "id long, auto_update boolean, content string")
    return log.where(F.col("method") == channel).select("doc", "ts", p["id"].alias("id"), p["auto_update"].alias("auto_update"), F.coalesce(p["content"], F.lit("")).alias("content"))


def carets(log: DataFrame) -> DataFrame:
    p = F.from_json("params", "line int, character int")
    return log.where(F.col("method") == CARET).select("doc", "ts", p["line"].alias("line"), p["character"].alias("character"))


def active_states(log: DataFrame) -> DataFrame:
    """``doc, id``: the panel ids that replies to ``state_init`` gave; a reply without one is an error when computed."""
    requests = log.where((F.col("method") == STATE_INIT) & (F.col("direction") == "out")).select("doc", "id", "ts")
    replies = log.where(F.col("direction") == "reply").select("doc", "id", "ts", F.get_json_object("params", "$.state_id").cast("long").alias("state"))
    both = requests.join(replies.select("doc", "id", "state"), ["doc", "id"])
    state = F.when(F.col("state").isNull(), F.raise_error(F.lit("no state_id in a reply"))).otherwise(F.col("state"))
    return both.select("doc", state.alias("id")).distinct()


def panels_at_carets(log: DataFrame, only_active: bool = True) -> DataFrame:
    """``doc, ts, line, character, content``: the last output before the next caret move, by caret.

    An output belongs to the caret at its arrival, however late it is. Carets
    without any output have NULL content.
    """
    shown = outputs(log)
    if only_active:
        shown = shown.join(active_states(log), ["doc", "id"], "left_semi")
    moved = carets(log)
    owner = correlate.as_of(shown.select("doc", "ts", "content"), moved, ["doc"], "ts", ["line", "character"])
    last = owner.where("matched_ts is not null").groupBy("doc", "matched_ts").agg(F.max_by("content", "ts").alias("content"), F.count(F.lit(1)).alias("n_outputs"))
    return moved.join(last.withColumnRenamed("matched_ts", "ts"), ["doc", "ts"], "left").withColumn("n_outputs", F.coalesce("n_outputs", F.lit(0)))


def quiet_sessions(messages: DataFrame, quiet: str = "350 milliseconds", late: str | None = "2 seconds") -> DataFrame:
    """Bursts of messages per document that end with a pause of ``quiet``; works on tables and on streams.

    late: the watermark of a stream; what comes later than that is dropped.
    """
    timed = messages.withWatermark("ts", late) if messages.isStreaming and late else messages
    burst = timed.groupBy("doc", F.session_window("ts", quiet).alias("w"))
    out = burst.agg(F.count(F.lit(1)).alias("n_messages"), F.max_by("content", "ts").alias("content"))
    return out.select("doc", F.col("w.start").alias("first_ts"), F.col("w.end").alias("quiet_ts"), "n_messages", "content")


def settled_panels(log: DataFrame, settle_ms: int = 2000, only_active: bool = True) -> DataFrame:
    """Stream form of ``panels_at_carets``: one row per caret once the next caret comes or it has settled.

    Per document the state is one open caret with its last output, and the ids
    of its panels: those asked for and those that a reply made active. At one
    time replies come before carets and carets before outputs. An output that
    comes before its panel's reply doesn't count. A caret settles ``settle_ms``
    of event time after the move, when the watermark passes.
    """
    p = F.from_json("params", "line int, character int, content string, id string, state_id string")
    asks = (F.col("method") == STATE_INIT) & (F.col("direction") == "out")
    kind = F.when(asks, 0).when(F.col("direction") == "reply", 1).when(F.col("method") == CARET, 2).when(F.col("method") == STATE_OUTPUT, 3)
    rows = log.withColumn("kind", kind).where("kind is not null").withWatermark("ts", f"{settle_ms} milliseconds")
    number = F.when(F.col("kind") == 3, p["id"]).otherwise(F.col("id").cast("string"))
    rows = rows.select(
        "doc", "ts", "kind", number.alias("number"), p["state_id"].alias("panel"), p["line"].alias("line"), p["character"].alias("character"),
        F.coalesce(p["content"], F.lit("")).alias("content"),
    )

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done = []
        *now, asked, active = state.get if state.exists else (NO_CARET, 0, 0, None, 0, "", "")
        asked, active = set(asked.split()), set(active.split())

        def close() -> None:
            if now[0] != NO_CARET:
                done.append((key[0], pd.Timestamp(now[0], unit="us"), *now[1:]))
            now[:] = [NO_CARET, 0, 0, None, 0]

        if state.hasTimedOut:
            close()
        else:
            frame = pd.concat(list(batches)).sort_values(["ts", "kind"], kind="stable")
            for r in frame.itertuples():
                if r.kind == 0:
                    asked.add(r.number)
                elif r.kind == 1 and r.number in asked:
                    if not isinstance(r.panel, str):
                        raise ValueError("no state_id in a reply")
                    asked.discard(r.number)
                    active.add(r.panel)
                elif r.kind == 2:
                    close()
                    now[:] = [int(r.ts.value // 1000), int(r.line), int(r.character), None, 0]
                elif r.kind == 3 and now[0] != NO_CARET and (not only_active or r.number in active):
                    now[3:] = [r.content, now[4] + 1]
        state.update((*now, " ".join(sorted(asked)), " ".join(sorted(active))))
        if now[0] != NO_CARET:
            state.setTimeoutTimestamp(max(now[0] // 1000 + settle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["doc", "ts", "line", "character", "content", "n_outputs"])

    return rows.groupBy("doc").applyInPandasWithState(
        fold, "doc string, ts timestamp, line int, character int, content string, n_outputs int",
        "ts long, line int, character int, content string, n int, asked string, active string", "append", "EventTimeTimeout",
    )
