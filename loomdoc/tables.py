"""Table access: every query reads its inputs through :func:`load`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; the folder may be any URI that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
