"""Readers for the parquet tables the jobs run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Parquet scan of ``{base}/{name}.parquet``; columns are pruned and
    filters pushed by Catalyst from whatever the caller selects."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
