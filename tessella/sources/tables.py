"""Access to the named tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of ``folder``; any path that Spark can read will do."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
