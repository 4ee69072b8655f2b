"""The read side of a story library: lookups, search, cards, progress.

Frames follow one model: stories ``story``, an index ``story, index, title`` and
chapters ``story, volume, index, title, paragraphs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(index: DataFrame, chapters: DataFrame, wanted: DataFrame, mode: str = "robust", volume_size: int = 50) -> DataFrame:
    """``story, index, title, paragraphs`` of every wanted ``story, index``; null where there is none.

    ``strict`` computes the volume from the position in the index, as a static
    reader does, and misses chapters whose volume was cut elsewhere; ``robust``
    looks the chapter up by its index.
    """
    body = chapters.select("story", "index", "volume", "title", "paragraphs")
    if mode == "robust":
        return wanted.join(body.drop("volume"), ["story", "index"], "left")
    if mode != "strict":
        raise ValueError(f"mode is strict or robust, not {mode}")
    position = F.row_number().over(Window.partitionBy("story").orderBy("index")) - 1
    placed = index.select("story", "index", (F.floor(position / volume_size) + 1).cast("int").alias("volume"))
    return wanted.join(placed, ["story", "index"], "left").join(body, ["story", "volume", "index"], "left").drop("volume")


def title_or(title: Column, fallback: Column) -> Column:
    """``title`` unless it is null or empty."""
    return F.coalesce(F.nullif(title, F.lit("")), fallback)


def cards(stories: DataFrame, index: DataFrame, metadata: DataFrame) -> DataFrame:
    """``story, title, n_chapters``: titles fall back to the story's name, counts to 0."""
    counts = index.groupBy("story").agg(F.count("*").alias("n"))
    joined = stories.join(counts, "story", "left").join(metadata.select("story", "story_title"), "story", "left")
    return joined.select("story", title_or(F.col("story_title"), F.col("story")).alias("title"), F.coalesce("n", F.lit(0)).alias("n_chapters"))


def first_source(listing: DataFrame) -> DataFrame:
    """Of every ``story`` the row of its first source (least ``source_ord``)."""
    return listing.groupBy("story").agg(F.min_by("source", "source_ord").alias("source"))


def search(index: DataFrame, query: str) -> DataFrame:
    """Index rows whose title holds the query, in any case, or whose number does; all rows for an empty query."""
    wanted = query.strip().lower()
    if not wanted:
        return index
    return index.where(F.contains(F.lower("title"), F.lit(wanted)) | F.contains((F.col("index") + 1).cast("string"), F.lit(wanted)))


def totals(index: DataFrame) -> DataFrame:
    """Chapters of a story as counted, and as the reader shows them (last index plus one)."""
    return index.groupBy("story").agg(F.count("*").alias("n_chapters"), (F.max("index") + 1).alias("total"))


def latest_progress(events: DataFrame) -> DataFrame:
    """The last ``chapter_idx`` of every ``user_id, slug``; of equal times the greatest ``event_id``."""
    return events.groupBy("user_id", "slug").agg(F.max_by("chapter_idx", F.struct("ts", "event_id")).alias("chapter_idx"))


def with_progress(index: DataFrame, progress: DataFrame, keys: list[str]) -> DataFrame:
    """Index rows with ``is_read`` and ``is_current``; without progress both are false."""
    joined = index.join(progress, keys, "left")
    at = F.col("chapter_idx")
    return joined.withColumns({"is_read": F.coalesce(at >= F.col("index"), F.lit(False)), "is_current": F.coalesce(at == F.col("index"), F.lit(False))})


def percent(at: Column, total: Column) -> Column:
    """Half-up rounded percentage; 0 before the start."""
    return F.when(at >= 0, F.floor(at / total * 100 + 0.5)).otherwise(0).cast("int")


def neighbours(at: Column, total: Column) -> tuple[Column, Column]:
    """Whether there is a chapter before and after."""
    return at > 0, at < total - 1
