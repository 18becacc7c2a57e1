"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Read one parquet table; projections and filters applied later reach the scan."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
