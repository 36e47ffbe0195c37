"""Command line: ``python -m stepforge.cli merge|harvest|sample ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.operators.merge import merge_shards
from stepforge.plans import harvest
from stepforge.sources import corpus, jsonl


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stepforge")
    sub = top.add_subparsers(dest="command", required=True)
    m = sub.add_parser("merge", help="merge shard_* folders and audit the result")
    m.add_argument("shard_root")
    m.add_argument("--out", required=True)
    m.add_argument("--test-entries", help="held-out entries; status 1 if one is in the data")
    m.add_argument("--expect-entries", help="entries that should be covered")
    m.add_argument("--fail-before-write", action="store_true", help="stop on leakage before anything is written")
    h = sub.add_parser("harvest", help="sources to states and transitions")
    h.add_argument("--corpus", required=True, help="folder above the entry folders")
    h.add_argument("--out", required=True)
    h.add_argument("--panels", help="captured panels (JSON lines: file, offset, content); without, mock states")
    h.add_argument("--include", help="keep paths that match this pattern")
    h.add_argument("--entries", help="file of entries to keep")
    h.add_argument("--limit", type=int, help="the first so many files")
    h.add_argument("--shard", type=int)
    h.add_argument("--num-shards", type=int)
    h.add_argument("--resume", action="store_true", help="leave out files that the checkpoint names")
    h.add_argument("--mode", choices=("commands", "tokens"), default="commands")
    h.add_argument("--prefix-scope", choices=("proof", "file"), default="proof")
    h.add_argument("--format", choices=("jsonl", "json", "both", "parquet"), default="jsonl")
    s = sub.add_parser("sample", help="print some records of a dataset, always the same ones")
    s.add_argument("path")
    s.add_argument("--sample", type=int, default=3)
    return top


def _list(spark: SparkSession, path: str | None) -> DataFrame | None:
    return None if path is None else jsonl.read_entries(spark, path)


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if a.command == "merge":
        done = merge_shards(spark, a.shard_root, a.out, _list(spark, a.test_entries), _list(spark, a.expect_entries), a.fail_before_write)
        print(json.dumps(done.report, ensure_ascii=False))
        return done.status
    if a.command == "sample":
        rows = jsonl.read_lines(spark, a.path).orderBy(F.xxhash64("raw"), "raw").limit(a.sample)
        print(*[r.raw for r in rows.select("raw").collect()], sep="\n")
        return 0
    if a.resume and a.format == "json":
        raise SystemExit("--resume appends, which one JSON array does not allow: use jsonl, both or parquet")
    out = a.out.rstrip("/")
    checkpoint = f"{out}/states.checkpoint.jsonl"
    done = jsonl.read_lines(spark, checkpoint).select(F.get_json_object("raw", "$.file").alias("file")) if a.resume else None
    files = corpus.theories(spark, a.corpus)
    files = harvest.choose_files(files, a.include, _list(spark, a.entries), a.shard, a.num_shards, done, a.limit)
    panels = None if a.panels is None else spark.read.schema("file string, offset int, content string").json(a.panels)
    states = harvest.state_rows(files, panels, a.mode, a.prefix_scope).cache()
    rows = states.drop("kind", "proof_start", "proof_end", "start", "end")
    mode = "append" if a.resume else "overwrite"
    for name, frame in (("states", rows), ("transitions", harvest.transition_rows(states))):
        path = f"{out}/{name}.{'jsonl' if a.format in ('jsonl', 'both') else a.format}"
        if a.resume:  # what earlier runs wrote stays
            (frame.write.mode("append").parquet if a.format == "parquet" else frame.write.mode("append").json)(path)
            if a.format == "both":
                jsonl.write_array(spark.read.text(path), path)
        else:
            jsonl.write_rows(frame, path, a.format)
    files.select(F.col("path").alias("file")).write.mode(mode).json(checkpoint)  # last: names only what is written
    states.unpersist()
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("stepforge").getOrCreate()
    try:
        return run(spark, sys.argv[1:])
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
