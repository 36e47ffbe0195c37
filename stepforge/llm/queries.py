"""The driver's queries over the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepforge.llm import chat_format, circulant_minhash, cover_tree, html_text, lexical_packing, license_rules, line_dedup, repeated_passages, source_mix
from stepforge.llm.common import table


def op4_quality_rules(spark, sf_dir):
    from stepforge.llm.quality_rules import quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "quality.*")


def op1_extract_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = html_text.extract_text(pages)
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_cover_tree(spark, sf_dir):
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.95)


def op3_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    two = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat_format.digests(chat_format.read_back(chat_format.chat_format(rows.union(two))))


def op5_circulant_minhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return circulant_minhash.near_duplicates(docs, width=3, percent=85)


def op6_lexical_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = lexical_packing.lexical_packing(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs, t=2, min_chars=16, short=True).select(
        "doc_id", "n_lines", "n_equal", "n_near", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op8_license_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_rules.license_rules(docs).select(
        "doc_id",
        F.size("licence.sequence").cast("long").alias("n_known"),
        F.array_join("licence.sequence", " ").alias("sequence"),
        F.array_join("licence.matched", " ").alias("licences"),
    )


def op9_repeated_passages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_passages.remove_repeats(docs, window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return source_mix.source_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def vocabulary(name: str) -> str:
    """Where the public vocabulary ``name`` is."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    "op1_extract_text": op1_extract_text,
    "op2_cover_tree": op2_cover_tree,
    "op3_chat_format": op3_chat_format,
    "op4_quality_rules": op4_quality_rules,
    "op5_circulant_minhash": op5_circulant_minhash,
    "op6_lexical_packing": op6_lexical_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_rules": op8_license_rules,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_source_mix": op10_source_mix,
}
ORACLE_SQL: dict[str, str] = {
    "op8_license_rules": license_rules.oracle_sql(),
    "op10_source_mix": source_mix.oracle_sql(),
}
