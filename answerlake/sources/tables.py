"""Parquet tables (the driver's test tables and our own written indexes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Load a persisted index (written by ``sinks.write_index``)."""
    return spark.read.parquet(path)
