"""Readers of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; works for any file system that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
