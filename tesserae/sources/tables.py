"""Parquet tables of one data directory, by name."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's rows. Only Spark's reader touches the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
