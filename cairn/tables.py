"""Reading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def config_value(spark: SparkSession, sf_dir: str, key: str) -> str | None:
    """One value of the config table; of several rows with the key the largest value."""
    return table(spark, sf_dir, "config").where(F.col("key") == key).agg(F.max("value")).first()[0]
