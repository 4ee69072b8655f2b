"""Writing chapters: fixed batches, numbering, and rebuilding the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batched(chapters: DataFrame, keys: list[str], order: str, size: int = 50, first_volume: int = 1) -> DataFrame:
    """``chapters`` with their ``volume``: every ``size`` in order, the last one partial."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return chapters.withColumn("volume", (F.floor(place / size) + first_volume).cast("long"))


def volume_ranges(chapters: DataFrame, keys: list[str], index: str) -> DataFrame:
    """One row a volume with its 1-based range, size and file name."""
    ranges = chapters.groupBy(*keys, "volume").agg((F.min(index) + 1).alias("range_start"), (F.max(index) + 1).alias("range_end"), F.count("*").alias("n_chapters"))
    return ranges.withColumn("file_name", volume_name(F.col("volume"), F.col("range_start"), F.col("range_end")))


def volume_name(volume: Column, start: Column, end: Column) -> Column:
    """``vol-NNN-chAAA-BBB.json``; longer numbers are padded to three digits, never cut."""
    return F.format_string("vol-%03d-ch%03d-%03d.json", volume, start, end)


def next_volume(files: DataFrame, keys: list[str], name: str = "file_name") -> DataFrame:
    """The number after the greatest of the file names; names without a number don't count."""
    number = F.try_element_at(F.split(F.col(name), "-"), F.lit(2)).try_cast("int")
    return files.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_volume"))


def last_written(chapters: DataFrame, keys: list[str], volume: str, position: str) -> DataFrame:
    """Of the chapters with equal ``keys`` the one from the last volume and, in it, the last position."""
    rest = [c for c in chapters.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(volume, position)).alias("newest")
    return chapters.groupBy(*keys).agg(newest).select(*keys, "newest.*")
