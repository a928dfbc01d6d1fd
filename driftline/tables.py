"""Loading of the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.session import shipped


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder`` (a parquet file or a folder of them)."""
    return shipped(spark).read.parquet(f"{folder}/{name}.parquet")
