"""Mixing sources to target weights by a low-discrepancy schedule (operator 10).

Each source's documents are shuffled and laid end to end; its words are cut
into blocks of equal length. Points of the golden-ratio sequence, mapped
through the cumulative block quotas, deal one slot after another to a source;
the r-th slot of a source takes its block r (from the start again after the
last one). What a document gives to the mix is the part of it that lies in
taken blocks. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm.common import WORD_PATTERN, Scratch

#: Fixed value: 2^31 divided by the golden ratio, the nearest odd integer.
GOLDEN_31 = 1327217885
PERIOD = 1 << 31
#: Parts of a source's shuffled order; running totals are taken in two levels.
ORDER_BUCKETS = 4096
#: Slots that are ranked together; ranks are taken in two levels.
SLOT_CHUNK = 4096
#: Bins that hold the sources' stretches of the cumulative quotas.
QUOTA_BINS = 1024


def shuffle_key(seed: int, doc_id: str) -> Column:
    """60 bits of an md5: the place of a document in its source's order."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string"))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share_percent: int, most_times: int) -> DataFrame:
    """One row per source of ``sizes(source, size)``: ``source, source_size, target``.

    Sources in code-point order, NULL last, take the weights in turn. A target
    stops at ``most_times`` the source's size; what is over goes to the others
    by weight. Sorted by limit over weight, a source is at its limit exactly
    if an even rise of all open sources reaches it, so one pass over running
    sums gives what repeated resharing converges to.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("ordinal") - 1, F.lit(len(weights))) + 1).cast("int"))
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.withColumn("ordinal", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", w).withColumn("limit", F.col("source_size") * most_times)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * share_percent / F.lit(100.0)
    rise = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    full = ranked.withColumn("total", total).withColumn("full", F.col("limit") <= F.col("weight") * rise)
    over = lambda c: F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(everything), F.lit(0))
    open_weight = F.sum("weight").over(everything) - over("weight")
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(
        F.col("weight") * ((F.col("total") - over("limit")) / open_weight)
    )
    return full.withColumn("target", target).select("source", "ordinal", "source_size", "target")


def quotas(targets: DataFrame, block: int, most_times: int) -> DataFrame:
    """Adds per source: words to take, blocks, slots, and the running total of slots before it."""
    size = F.greatest("source_size", F.lit(1))
    rest = F.pmod(F.col("words"), size)
    ceil_div = lambda c: F.floor((c + F.lit(block - 1)) / F.lit(block)).cast("long")
    out = targets.withColumn("words", F.least(F.round("target").cast("long"), F.col("source_size") * most_times))
    out = out.withColumn("blocks", ceil_div(F.col("source_size"))).withColumn(
        "slots", F.floor(F.col("words") / size).cast("long") * F.col("blocks") + ceil_div(rest)
    )
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(rest % block == 0, F.lit(block)).otherwise(rest % block).cast("long")
    return out.withColumn("last_words", last).withColumn("slots_before", F.coalesce(F.sum("slots").over(before), F.lit(0)))


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """``ordinal, rank, slot``: which source each slot goes to, and its rank among that source's slots.

    Ranks beyond a source's quota go, and ranks that the sequence has not yet
    reached (its error is of the order of log n) are added behind the last slot.
    """
    spark = sources.sparkSession
    width = max(1, -(-n_slots // QUOTA_BINS))
    point = F.pmod(F.pmod(F.col("id") + 1, F.lit(PERIOD)) * F.lit(GOLDEN_31), F.lit(PERIOD))
    place = F.least(F.floor(point / F.lit(float(PERIOD)) * n_slots).cast("long"), F.lit(n_slots - 1))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), place.alias("place"))
    stretch = sources.where("slots > 0").select("ordinal", "slots", "slots_before").withColumn(
        "bin", F.explode(F.sequence(F.floor(F.col("slots_before") / width), F.floor((F.col("slots_before") + F.col("slots") - 1) / width)))
    )
    dealt = slots.withColumn("bin", F.floor(F.col("place") / width)).join(stretch, "bin")
    dealt = dealt.where((F.col("place") >= F.col("slots_before")) & (F.col("place") < F.col("slots_before") + F.col("slots")))
    dealt = dealt.select("ordinal", "slots", "slot", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    counts = dealt.groupBy("ordinal", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("ordinal").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("first_rank", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("ordinal", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("within", within).join(starts, ["ordinal", "chunk"])
    ranked = ranked.select("ordinal", (F.col("first_rank") + F.col("within")).alias("rank"), "slot", "slots").where("rank < slots")
    reached = counts.groupBy("ordinal").agg(F.sum("n").alias("reached"))
    late = sources.where("slots > 0").join(reached, "ordinal", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    late = late.where("reached < slots").select("ordinal", F.explode(F.sequence("reached", F.col("slots") - 1)).alias("rank"))
    return ranked.select("ordinal", "rank", "slot").union(late.select("ordinal", "rank", F.lit(n_slots).cast("long")))


def source_mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share_percent: int = 150,
    most_times: int = 2,
    block_words: int = 512,
    seed: int = 7,
    scratch: Scratch | None = None,
) -> DataFrame:
    """What the mix takes of each row: ``doc_id, source, text_hash, size, source_size, target, taken, slots``.

    slots: for each copy of the row that the mix takes, the schedule's slot at
    which it begins; in their order every stretch of the mix holds the sources
    in about their shares.
    ``taken`` counts words with repeats; ``taken / size`` whole copies of the
    text and then its first ``taken % size`` words. Reruns agree: the order
    depends on ``seed`` and ``doc_id`` alone, ties by hash of the text.

    NULL text counts as empty; such rows have size and taken 0. A NULL source
    is a source of its own, after all others. A NULL doc_id is ordered last.
    Repeated rows count once each. An empty table gives an empty table. Other
    columns, whatever their names, are not read.

    Scale: running totals over a source, which may hold a third of all rows,
    are taken in two levels (4096 hash buckets per source); blocks are keyed by
    (source, block), so no key is hot; per-source rows alone meet in one task.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = scratch.write(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("text_hash"),
            F.regexp_count(body, F.lit(WORD_PATTERN)).cast("long").alias("size"),
            F.coalesce(shuffle_key(seed, doc_id), F.lit((1 << 60) - 1)).alias("key"),
        )
    )
    sources = scratch.write(quotas(source_targets(rows, weights, share_percent, most_times), block_words, most_times))
    n_slots = sources.agg(F.sum("slots")).first()[0] or 0

    placed = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    placed = placed.select("r.*", "ordinal", "source_size", "target", "blocks", "slots", "last_words").withColumn(
        "bucket", F.shiftright("key", 60 - (ORDER_BUCKETS.bit_length() - 1))
    )
    filled = placed.where("size > 0")
    before = Window.partitionBy("ordinal").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.groupBy("ordinal", "bucket").agg(F.sum("size").alias("n"))
    starts = starts.withColumn("bucket_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    earlier = Window.partitionBy("ordinal", "bucket").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("start", F.coalesce(F.sum("size").over(earlier), F.lit(0))).join(starts, ["ordinal", "bucket"])
    filled = filled.withColumn("start", F.col("start") + F.col("bucket_start")).withColumn("end", F.col("start") + F.col("size"))
    pieces = filled.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words)))
    )
    keep = ["doc_id", "source", "text_hash", "size", "source_size", "target"]
    if n_slots:
        slots = schedule(sources, n_slots)
        used = slots.join(sources.select("ordinal", "blocks", "slots", "last_words"), "ordinal").select(
            "ordinal", F.pmod("rank", "blocks").alias("block"), "slot", F.floor(F.col("rank") / F.col("blocks")).alias("turn"),
            F.when(F.col("rank") == F.col("slots") - 1, F.col("last_words")).otherwise(F.lit(block_words)).alias("use"),
        )
        block_start = F.col("block") * block_words
        part = F.least(F.col("end"), block_start + F.col("use")) - F.greatest(F.col("start"), block_start)
        joined = pieces.join(used, ["ordinal", "block"], "left").withColumn("part", F.when(F.col("use").isNull(), 0).otherwise(F.greatest(part, F.lit(0))))
    else:
        joined = pieces.withColumn("part", F.lit(0).cast("long")).withColumns({"slot": F.lit(None).cast("long"), "turn": F.lit(None).cast("long")})
    first = [F.min(F.when((F.col("turn") == k) & (F.col("part") > 0), F.col("slot"))) for k in range(most_times)]
    taken = joined.groupBy("ordinal", "start", *keep).agg(F.sum("part").alias("taken"), F.filter(F.array(*first), lambda x: x.isNotNull()).alias("slots"))
    empty = placed.where("size = 0").select(*keep, F.lit(0).cast("long").alias("taken"), F.array().cast("array<bigint>").alias("slots"))
    return taken.select(*keep, "taken", "slots").union(empty)


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", slot: str | None = None, **options) -> DataFrame:
    """The mix itself: ``docs`` with each row once per copy taken, the last copy cut to the words taken.

    A cut copy has its words joined by one space; whole copies keep their text.
    Rows of which nothing is taken go. All columns are returned, and the slot at
    which a copy begins if a name for it is given. The rows come in the order
    of the schedule: ranges of slots over partitions, sorted within.
    """
    taken = source_mix(docs, doc_id, text, source, **options)
    same = Window.partitionBy("__id", "__source", "__hash").orderBy("__id")
    keys = {"__id": F.col(doc_id), "__source": F.col(source), "__hash": F.xxhash64(text)}
    left = docs.withColumns(keys).withColumn("__nth", F.row_number().over(same))
    right = taken.where("taken > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"),
        F.col("size").alias("__size"), F.col("taken").alias("__taken"), F.col("slots").alias("__slots"),
    )
    right = right.withColumn("__nth", F.row_number().over(same.orderBy("__taken")))
    l, r = left.alias("l"), right.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("__id", "__source", "__hash", "__nth")]
    both = l.join(r, on).select("l.*", "__size", "__taken", "__slots")
    copies = F.ceil(F.col("__taken") / F.col("__size")).cast("long")
    both = both.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})")), F.lit(1), F.pmod("__taken", "__size").cast("int")), " ")
    whole = F.col("__copy") * F.col("__size") <= F.col("__taken")
    # a copy that begins in the last one's last block has no slot of its own
    begins = F.coalesce(F.get("__slots", (F.col("__copy") - 1).cast("int")), F.array_max("__slots"))
    mixed = both.withColumn(text, F.when(whole, F.col(text)).otherwise(cut)).withColumn("__slot", begins)
    mixed = mixed.repartitionByRange("__slot", F.xxhash64("__id")).sortWithinPartitions("__slot", "__id", "__copy")
    return mixed.select(*docs.columns, *([] if slot is None else [F.col("__slot").alias(slot)]))


def oracle_sql(block_words: int = 512, seed: int = 7) -> str:
    """DuckDB SQL for the rows of the query, from the schedule's closed form."""
    return f"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}')) AS size,
    CAST('0x' || substr(md5('{seed}:' || doc_id), 1, 15) AS BIGINT) AS key FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS ordinal, source_size * 2 AS lim FROM per_source),
weighted AS (SELECT *, [3, 1, 2][(ordinal - 1) % 3 + 1] AS weight FROM ranked),
running AS (
  SELECT *, CAST(sum(source_size) OVER () * 150 AS DOUBLE) / 100.0 AS total, sum(weight) OVER () AS weights,
    coalesce(sum(lim) OVER w, 0) AS lim_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM weighted WINDOW w AS (ORDER BY lim / weight, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, lim <= weight * ((total - lim_before) / (weights - weight_before)) AS is_full FROM running),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(lim AS DOUBLE) ELSE
    weight * ((total - coalesce(sum(CASE WHEN is_full THEN lim END) OVER (), 0))
      / (weights - coalesce(sum(CASE WHEN is_full THEN weight END) OVER (), 0))) END AS target
  FROM filled),
placed AS (
  SELECT doc_id, size, source_size, target, least(CAST(round(target) AS BIGINT), 2 * source_size) AS words,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE (words // source_size) * size
    + greatest(0, least(first + size, words % source_size) - first) END AS BIGINT) AS taken
FROM placed"""
