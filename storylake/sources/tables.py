"""Reading the tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; any file system that Spark knows."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
