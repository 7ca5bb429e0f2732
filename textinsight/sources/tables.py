"""Parquet tables, spread over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread


def read_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A parquet table; a small one has a partition per core, since a file is not split below its row groups."""
    return spread(spark.read.parquet(path), key)
