"""Parquet table loading for the driver-provided datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan; column pruning and filter pushdown happen in the optimizer."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
