"""Reading of the input tables by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.tables import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, one small file dealt out over the cores."""
    return dealt(table(spark, sf_dir, "documents"))
