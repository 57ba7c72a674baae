"""Readers for the driver tables (a parquet file, or a folder of them, per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``spark.read.parquet`` of one table; column pruning and filters are
    pushed into the scan by Catalyst, so callers select only what they use."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stream_path(sf_dir: str, name: str) -> str:
    """Path of a table for ``readStream``, whether it is one file or a folder of
    files: a pattern that fits the table's name only (a plain path must be a folder)."""
    return os.path.join(sf_dir, f"{name}.parque[t]")
