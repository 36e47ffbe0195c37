"""Queries: lines, carets, words, offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.functions.text import first_word, line_and_character, rstrip, split_lines, strip
from stepforge.sources.tables import table

#: Words that the head-word filter looks for.
HEADS = ["The", "In", "Licensed", "De"]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def line_explode(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", (F.col("pos") + 1).alias("line_no"), F.length("line").alias("line_len"))


def blank_lines_dropped(spark, sf_dir):
    kept = _lines(spark, sf_dir).where(strip("line") != "")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


def caret_positions(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", F.col("pos").alias("line"), F.length(rstrip("line")).alias("character"))


def first_word_filter(spark, sf_dir):
    head = first_word("line")
    return _lines(spark, sf_dir).where(head.isin(HEADS)).select("doc_id", "pos", head.alias("head"))


def probe_top8(spark, sf_dir):
    from pyspark.sql import Window

    hit = _lines(spark, sf_dir).where(first_word("line").isin(HEADS))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return hit.withColumn("n", n).where("n <= 8").select("doc_id", "pos", F.substr("line", F.lit(1), F.lit(70)).alias("shown"))


def offset_to_linecol(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.length("text") / 2).cast("long").alias("offset"))
    line, character = line_and_character("text", "offset")
    return docs.select("doc_id", "offset", line.alias("line"), character.alias("character"))


def token_stops(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "[ \n]+")).alias("w")).where("w <> ''")
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_stops"))


def splitlines_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(split_lines("text")).alias("n_lines"))


def null_members_dropped(spark, sf_dir):
    row = F.struct(F.lit("2.0").alias("jsonrpc"), F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", F.col("lang")).alias("params"))
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(row).alias("message"))


QUERIES = {
    f.__name__: f
    for f in (
        line_explode, blank_lines_dropped, caret_positions, first_word_filter, probe_top8, offset_to_linecol, token_stops,
        splitlines_count, null_members_dropped,
    )
}
_L = "(SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"
_HEADS = ", ".join(f"'{h}'" for h in HEADS)
ORACLE_SQL = {
    "line_explode": f"SELECT doc_id, CAST(pos + 1 AS INTEGER) AS line_no, length(line) AS line_len FROM {_L}",
    "blank_lines_dropped": f"SELECT doc_id, count(*) AS n_lines FROM {_L} WHERE trim(line) <> '' GROUP BY doc_id",
    "caret_positions": f"SELECT doc_id, CAST(pos AS INTEGER) AS line, length(rtrim(line)) AS character FROM {_L}",
    "first_word_filter": f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, split_part(trim(line), ' ', 1) AS head FROM {_L} WHERE split_part(trim(line), ' ', 1) IN ({_HEADS})",
    "probe_top8": f"""SELECT doc_id, pos, shown FROM (SELECT doc_id, CAST(pos AS INTEGER) AS pos, substr(line, 1, 70) AS shown,
  row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM {_L} WHERE split_part(trim(line), ' ', 1) IN ({_HEADS})) WHERE n <= 8""",
    "offset_to_linecol": """SELECT doc_id, o AS "offset", CAST(len(string_split(p, chr(10))) AS INTEGER) AS line, length(string_split(p, chr(10))[-1]) AS character
  FROM (SELECT doc_id, length(text) // 2 AS o, substr(text, 1, length(text) // 2) AS p FROM documents)""",
    "token_stops": """SELECT doc_id, count(*) AS n_stops FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents) WHERE w <> '' GROUP BY doc_id""",
    "splitlines_count": """SELECT doc_id, CAST(len(p) - CASE WHEN p[-1] = '' THEN 1 ELSE 0 END AS INTEGER) AS n_lines FROM
  (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)""",
    "null_members_dropped": """SELECT doc_id, '{"jsonrpc":"2.0","id":' || doc_id || CASE WHEN lang = 'en' THEN ',"params":"en"' ELSE '' END || '}' AS message FROM documents""",
}
