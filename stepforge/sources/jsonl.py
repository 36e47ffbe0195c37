"""Line-delimited JSON: tolerant scan, sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions.text import strip

STATES = (
    "file string, line long, character long, offset long, command string, in_proof boolean, prefix string, state string, continuation string"
)
TRANSITIONS = "file string, line long, character long, tactic string, state_before string, state_after string"


def parse_lines(lines: DataFrame, schema: str, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(good, bad): lines with a struct ``rec``, and those that are no JSON object.

    Blank lines are in neither. The raw line is kept, so fields that the schema
    lacks survive a merge. A line holds one object and nothing behind it;
    numbers, strings and arrays on a line of their own count as bad. A field of
    another type than the schema's is converted if it can be (5.0 and "5" to
    5), and NULL if not; the line stays.
    """
    full = lines.where(strip(raw) != "")
    alone = F.try_parse_json(F.concat(F.lit("["), F.col(raw), F.lit("]")))  # what stands behind the object makes this invalid, or longer
    is_good = F.startswith(strip(raw), F.lit("{")) & F.coalesce(F.size(alone.cast("array<variant>")) == 1, F.lit(False))
    fields = [x.split() for x in schema.split(", ")]
    loose = F.from_json(strip(raw), ", ".join(f"{n} string" for n, _ in fields))

    def typed(name: str, kind: str) -> Column:
        value = loose[name]
        if kind in ("long", "int"):  # also from 5.0
            return F.coalesce(value.try_cast(kind), value.try_cast("double").try_cast(kind))
        return value if kind == "string" else value.try_cast(kind)

    rec = F.struct(*[typed(n, k).alias(n) for n, k in fields])
    marked = full.withColumn("__good", is_good)
    return marked.where("__good").drop("__good").withColumn("rec", rec), marked.where("not __good").drop("__good")


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(found))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, line_no, raw`` of all lines; line numbers count from 1 and blank lines too.

    A path or pattern that matches nothing gives an empty frame. A file is read
    as one row to number its lines, so it must fit in a task.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "file_path string, line_no int, raw string")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    lines = F.split("value", "\r\n|\r|\n")
    out = whole.select("file_path", F.posexplode(lines).alias("pos", "raw"))
    return out.select("file_path", (F.col("pos") + 1).alias("line_no"), "raw")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, raw`` without line numbers; large files are split over tasks."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "file_path string, raw string")
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("raw"))


def read_entries(spark: SparkSession, path: str, out: str = "entry") -> DataFrame:
    """Distinct, trimmed, non-blank lines of an entry list."""
    return spark.read.text(path).select(strip("value").alias(out)).where(F.col(out) != "").distinct()


def shard_of(file_path: str | Column) -> Column:
    """The innermost folder ``shard_*`` that a file lies in, at any depth: Spark writes folders of part files."""
    c = F.col(file_path) if isinstance(file_path, str) else file_path
    return F.regexp_extract(c, r".*/(shard_[^/]*)/", 1)


def write_rows(df: DataFrame, path: str, encoding: str = "jsonl", raw: str | None = None) -> None:
    """Writes JSON lines (``jsonl``), one JSON array (``json``), ``both`` or ``parquet``; what is there is replaced.

    raw: a column of finished lines, written as they are. The array form is
    one file and streams through the driver row by row; it is for small outputs.
    """
    if encoding not in ("jsonl", "json", "both", "parquet"):
        raise ValueError(f"unknown encoding {encoding}")
    if encoding == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    lines = df.select(F.col(raw).alias("value")) if raw else df.select(F.to_json(F.struct("*")).alias("value"))
    if encoding in ("jsonl", "both"):
        lines.write.mode("overwrite").text(path)
    if encoding in ("json", "both"):
        write_array(lines, path)


def write_array(lines: DataFrame, path: str) -> None:
    """The finished lines in ``value`` as one JSON array beside ``path``."""
    context = lines.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".json")
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    try:
        before = "[\n"
        for row in lines.toLocalIterator():
            stream.write(bytearray((before + json.dumps(json.loads(row[0]), ensure_ascii=False)).encode()))
            before = ",\n"
        stream.write(bytearray(b"[]\n" if before == "[\n" else b"\n]\n"))
    finally:
        stream.close()
