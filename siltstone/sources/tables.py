"""Readers of the star-schema and corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``, read only through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
