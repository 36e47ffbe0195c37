"""Corpus files: theories, session files, imports, checkpoints, outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions.roots import sessions
from stepforge.functions.text import entry_under, parent_name
from stepforge.operators.lookup import chains


def _whole(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path, text`` of all files below ``root`` whose name matches; bad UTF-8 is replaced, not refused."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    found = reader.format("binaryFile").load(root).select("path", "content")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "/+", "/")
    return found.select(path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def theories(spark: SparkSession, root: str) -> DataFrame:
    """``path, entry_ref, entry_root, theory, text``: entry_ref is the file's folder, entry_root the first folder below ``root``."""
    files = _whole(spark, root, "*.thy")
    name = F.regexp_extract("path", r"([^/]*)\.thy$", 1)
    return files.select("path", parent_name("path").alias("entry_ref"), entry_under("path", root).alias("entry_root"), name.alias("theory"), "text")


def session_table(spark: SparkSession, root: str) -> DataFrame:
    """One row per session of the ``ROOT`` files below ``root``."""
    return sessions(_whole(spark, root, "ROOT"))


def session_roots(table: DataFrame) -> DataFrame:
    """``session, root, depth``: where each session's chain of parents ends (``HOL``, ``Pure``)."""
    return chains(table, "session", "parent")


def hol_only(table: DataFrame) -> DataFrame:
    """Sessions that need nothing but the base logic: the first ones to plan."""
    return table.where(F.col("parent") == "HOL")


def parent_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("parent").agg(F.count(F.lit(1)).alias("n_sessions"))


def imports(files: DataFrame) -> DataFrame:
    """``path, imported``: names that a theory's header imports, without quotes and folders kept apart."""
    header = F.regexp_extract("text", r"(?s)\bimports\b(.*?)\b(?:keywords|abbrevs|begin)\b", 1)
    names = F.regexp_extract_all(header, F.lit(r"""("[^"]*"|[^\s"]+)"""))
    return files.select("path", F.explode(names).alias("n")).select("path", F.regexp_replace("n", '"', "").alias("imported"))


def resolve_imports(found: DataFrame, files: DataFrame, sessions_: DataFrame) -> DataFrame:
    """``path, imported, target``: the file that an import means, or NULL.

    ``Session.Theory`` is looked up among the sessions, ``Folder/Theory`` and
    ``Theory`` beside the importing file. Base names alone are never keys.
    """
    beside = F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("imported"), F.lit(".thy"))
    up = F.regexp_replace(beside, r"[^/]+/\.\./", "")
    names = files.select(F.col("path").alias("target"), F.col("entry_root").alias("__e"), F.col("theory").alias("__t"))
    local = found.withColumn("__p", up).join(names.select(F.col("target").alias("__p"), "target"), "__p", "left").drop("__p")
    qualified = local.withColumns({"__s": F.substring_index("imported", ".", 1), "__t": F.substring_index("imported", ".", -1)})
    owner = sessions_.select(F.col("session").alias("__s"), F.col("entry").alias("__e")).dropDuplicates(["__s"])
    far = qualified.join(owner, "__s", "left").join(
        names.groupBy("__e", "__t").agg(F.min("target").alias("__far")), ["__e", "__t"], "left"
    )
    return far.select("path", "imported", F.coalesce("target", F.when(F.contains("imported", F.lit(".")), F.col("__far"))).alias("target"))
