"""The folder that driver and executors share, and the tables that jobs leave there for a while."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and the path itself."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``, gone when the driver ends; on one machine without that setting, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("storylake.shared.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="storylake-")
        spark.conf.set("storylake.shared.dir", base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    files, where = _at(spark, path)
    files.mkdirs(where)  # a path that doesn't exist isn't kept for the exit hook
    files.deleteOnExit(where)
    files.delete(where, True)
    return path


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: loops stay flat and survive lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that is no longer read; nothing happens where it is gone already."""
    files, where = _at(spark, path)
    files.delete(where, True)


class Rounds:
    """The tables of a loop each of whose rounds reads the one before only: when a round is written, the last but one goes."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.label, self.path = spark, label, ""

    def settled(self, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, self.label)
        df.write.parquet(path)
        if self.path:
            removed(self.spark, self.path)
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)
