"""The corpus pipeline: five stages over ``documents``, each written and read again.

quality rules, line deduplication, near-duplicate removal, source mix, packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm import circulant_minhash, lexical_packing, line_dedup, quality_rules, source_mix
from stepforge.llm.common import WORD_PATTERN, Scratch, table
from stepforge.llm.queries import vocabulary

#: Code points of the shortest line that may differ by two edits.
MIN_LINE = 16
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.quality_rules(docs, vocabulary("piece_bpe_32k.model"), out="__quality")
    return judged.where("__quality.kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one, exactly or within two edits (short ones one or none).

    A document that lost lines goes if none but blank ones are left; n_chars
    follows the new text. Rows with a NULL doc_id stay whole, identical rows as
    often as they are; every row keeps its own lang and source.
    """
    cut = line_dedup.line_dedup(docs, t=2, min_chars=MIN_LINE, short=True, carry=("lang", "source"))
    left = F.col("kept_text").rlike(WORD_PATTERN)
    cut = cut.where(left | (F.col("n_equal") + F.col("n_near") == 0)).withColumn("text", F.col("kept_text"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    found = circulant_minhash.near_duplicates(docs, width=5, percent=80)
    return docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: documents once per copy taken; n_chars follows a cut text."""
    taken = source_mix.mixed_documents(docs)
    return taken.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of at most 4096 tokens, one row per piece."""
    pieces = lexical_packing.lexical_packing(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("packing", packing),
]

#: The stages count tokens of public vocabularies, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
