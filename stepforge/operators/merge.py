"""Merging sharded outputs into one dataset, with its report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions.text import parent_name
from stepforge.operators import audit
from stepforge.operators.dedup import first_wins
from stepforge.sources import jsonl

KEY = ("file", "line", "character", "tactic")
OK, LEAKED, NO_SHARDS = 0, 1, 2


class LeakageError(ValueError):
    """Held-out entries are in the data, and the caller asked to stop before writing."""


@dataclass
class Merge:
    """states, transitions: ``shard, line_no, raw`` of the rows kept; bad_lines; report: one row; status."""

    states: DataFrame | None
    transitions: DataFrame | None
    bad_lines: DataFrame | None
    report: dict
    status: int


def read_shards(spark: SparkSession, shard_root: str, name: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) lines of ``shard_*/<name>.jsonl`` with the shard and line number of each."""
    lines = jsonl.read_raw(spark, f"{shard_root.rstrip('/')}/shard_*/{name}.jsonl").withColumn("shard", jsonl.shard_of("file_path"))
    return jsonl.parse_lines(lines, schema)


def keep_first(rows: DataFrame) -> DataFrame:
    """Of rows with one key the first, by shard (as a string), file and line. Missing key parts equal each other."""
    has = {f.name for f in rows.schema["rec"].dataType.fields}
    keys = [F.col(f"rec.{k}") if k in has else F.lit(None).cast("string") for k in KEY]
    keyed = rows.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    return first_wins(keyed, [f"__k{i}" for i in range(len(KEY))], ["shard", "file_path", "line_no"]).drop(*[f"__k{i}" for i in range(len(KEY))])


def shard_names(spark: SparkSession, shard_root: str) -> list[str]:
    """Shard folders in string order (shard_10 before shard_2)."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shard_root.rstrip('/')}/shard_*")
    fs = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.globStatus(found) or [])


def merge_shards(
    spark: SparkSession,
    shard_root: str,
    out: str | None = None,
    held_out: DataFrame | None = None,
    expected: DataFrame | None = None,
    fail_before_write: bool = False,
) -> Merge:
    """Merges states and transitions of all shards and audits the result.

    held_out, expected: frames with a column ``entry``. Leakage is status 1 and
    comes after writing, unless ``fail_before_write``. A state without ``file`` is an error when
    the result is computed. Rows are written as they came, in shard and line order.
    """
    shards = shard_names(spark, shard_root)
    if not shards:
        return Merge(None, None, None, {"n_shards": 0}, NO_SHARDS)
    parts, bad, report = {}, None, {"n_shards": len(shards)}
    for name, schema in (("states", jsonl.STATES), ("transitions", jsonl.TRANSITIONS)):
        good, wrong = read_shards(spark, shard_root, name, schema)
        parts[name] = keep_first(good).cache()
        bad = wrong if bad is None else bad.unionByName(wrong)
        total, kept = good.count(), parts[name].count()
        report |= {f"n_{name}": kept, f"n_{name}_duplicates": total - kept}
    file = F.col("rec.file")
    strict = F.when(file.isNull(), F.raise_error(F.lit("a state without file"))).otherwise(file)
    entries = parts["states"].select(strict.alias("file")).distinct().select("file", parent_name("file").alias("entry")).cache()
    report["n_files"], report["n_entries"] = entries.count(), entries.select("entry").distinct().count()
    with_rows = {r[0] for r in jsonl.read_lines(spark, f"{shard_root.rstrip('/')}/shard_*/states.jsonl").select(jsonl.shard_of("file_path")).distinct().collect()}
    report["empty_shards"] = [s for s in shards if s not in with_rows]  # one name per shard
    report["kept_per_shard"] = {
        r["shard"]: r["count"]
        for r in parts["states"].select("shard").unionByName(parts["transitions"].select("shard")).groupBy("shard").count().collect()
    }
    if expected is not None:
        report |= audit.coverage(entries, expected, "entry").first().asDict()
        report["missing_e_g"] = [r[0] for r in audit.exemplars(audit.missing(expected, entries, "entry"), "entry").collect()]
    status = OK
    if held_out is not None:
        leaked = audit.present(entries, held_out, "entry")
        report["n_leaked"], report["leaked_e_g"] = leaked.count(), [r[0] for r in audit.exemplars(leaked, "entry").collect()]
        status = LEAKED if report["n_leaked"] else OK
        if status and fail_before_write:
            raise LeakageError(f"held-out entries: {report['leaked_e_g']}")
    if out is not None:
        for name, rows in parts.items():
            jsonl.write_rows(rows.orderBy("shard", "file_path", "line_no"), f"{out.rstrip('/')}/{name}.jsonl", raw="raw")
    return Merge(parts["states"], parts["transitions"], bad, report, status)
