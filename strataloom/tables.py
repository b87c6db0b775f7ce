"""Reading the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.session import ship


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale-factor directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
