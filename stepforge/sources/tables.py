"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; one file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
