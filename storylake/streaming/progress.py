"""Keyed state over event streams: latest progress, audio-cache keys, single flight."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from storylake.sources.shared import shared_path


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The table ``name`` of ``folder`` as a stream with its own schema."""
    path = f"{folder}/{name}.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema)
    if [f.rpartition("/")[2] for f in batch.inputFiles()] == [f"{name}.parquet"]:  # one file: streams read folders only
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(path)


def latest(stream: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Last value of every key; works on streams and tables alike."""
    return stream.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_insertions(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First insertion of every cache key; a key that is written again keeps its place."""
    return stream.groupBy(key).agg(F.min(F.struct(*order)).alias("first"))


def one_flight_each(stream: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """One request of each key within the watermark; the others share its result."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def in_order(rows: DataFrame, ts: str, slices: int, path: str) -> DataFrame:
    """A table replayed as a stream in the order of ``ts``: ``slices`` files below ``path``, one a micro-batch.

    Rows are cut by ranges of ``ts``, so equal times stay together, and files get
    times of change in that order, by which a stream takes them up.
    """
    spark = rows.sparkSession
    rows.repartitionByRange(slices, ts).write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().toString() for s in files.listStatus(where) if s.getPath().getName().startswith("part-"))
    for n, part in enumerate(parts):
        files.setTimes(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part), 1_000 * (n + 1), -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d").parquet(path)


@dataclass(frozen=True)
class Resumable:
    """What streams leave under one ``path``: ``rows`` in a folder a micro-batch, and the ``state`` from which they go on.

    A micro-batch that is replayed, because the driver was lost between its write
    and its commit, overwrites its own folder, so every row is there once. Runs
    with the same path go on where the last one ended, whoever started it.
    """

    spark: SparkSession
    path: str

    def write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/rows/batch_id={number}")

    def run(self, stream: DataFrame, mode: str = "append", write: Callable[[DataFrame, int], None] | None = None) -> None:
        """Read all present input of ``stream``; ``write`` stands in for :meth:`write`."""
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).foreachBatch(write or self.write).start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()

    def rows(self, schema: StructType, mode: str = "append") -> DataFrame:
        """Rows of all micro-batches, or for ``complete`` of the last one; none before the first."""
        if not self._started():
            return self.spark.createDataFrame([], schema)
        whole = StructType([*schema.fields, StructField("batch_id", LongType())])
        found = self.spark.read.schema(whole).option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        if mode == "complete":
            found = found.join(F.broadcast(found.agg(F.max("batch_id").alias("batch_id"))), "batch_id")
        return found.select(*schema.fieldNames())

    def _started(self) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def drained(stream: DataFrame, mode: str = "complete", path: str | None = None) -> DataFrame:
    """What a stream has given once all its present input is read; with the same ``path`` it goes on from the last run.

    Without a path the run is for once, in the shared folder.
    """
    kept = Resumable(stream.sparkSession, path or shared_path(stream.sparkSession, "stream"))
    kept.run(stream, mode)
    return kept.rows(stream.schema, mode)
