"""Story libraries on disk: ``<base>/<source>/<slug>/`` with metadata, index and volume files as JSON.

Source and slug stand in the path only. Every reader has an explicit schema, so
nothing is inferred and fields are taken by name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storylake.operators import library, volumes
from storylake.sources import named

INDEX = "index INT, title STRING"
METADATA = "story_title STRING"
VOLUME = "volume INT, chapterRange ARRAY<INT>, chapters ARRAY<STRUCT<title: STRING, paragraphs: ARRAY<STRING>, index: INT>>"
PROGRESS = "next_url STRING, next_index INT, story_title STRING"


def _placed(found: DataFrame, base: str) -> DataFrame:
    """Files ``name`` below ``base`` with ``source, slug, file_name``; hidden ones are passed over, as Spark's readers do."""
    path = F.concat_ws("/", F.lit(base.rstrip("/")), "name")
    part = lambda pattern: F.regexp_extract(path, pattern, 1)
    return found.where(~F.rlike("name", F.lit("(^|/)[._]"))).withColumns({"source": part(r"/([^/]+)/[^/]+/[^/]+$"), "slug": part(r"/([^/]+)/[^/]+$"), "file_name": part(r"/([^/]+)$")})


def _files(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    """Rows of the JSON files called ``name`` under any source and slug, an object or an array of them each; no rows where there are none.

    A file that isn't JSON is a row of nulls. Files are listed and read by tasks:
    Spark's own listing takes a task for every few folders and brings every file's status to the driver.
    """
    rows = f"ARRAY<STRUCT<{schema}>>"
    found = _placed(named.read_named(spark, base, name), base).where("trim(content) <> ''")
    read = F.coalesce(F.from_json("content", rows), F.array(F.lit(None)).cast(rows))
    return found.select("source", "slug", "file_name", F.explode(read).alias("row")).select("source", "slug", "file_name", "row.*")


@dataclass
class Library:
    """The tables of a library and the verbs of its data API."""

    spark: SparkSession
    base: str

    def index(self) -> DataFrame:
        """``source, slug, index, title`` in no order."""
        return _files(self.spark, self.base, "chapters_index.json", INDEX).drop("file_name")

    def metadata(self) -> DataFrame:
        return _files(self.spark, self.base, "metadata.json", METADATA).drop("file_name")

    def progress(self) -> DataFrame:
        """Crawl checkpoints: where to go on. Their names begin with an underscore, which Spark's own readers pass over."""
        found = named.read_named(self.spark, self.base, "_progress.json")
        at = F.split("name", "/")
        return found.select(F.element_at(at, -3).alias("source"), F.element_at(at, -2).alias("slug"), F.from_json("content", PROGRESS).alias("p")).select("source", "slug", "p.*")

    def chapters(self) -> DataFrame:
        """``source, slug, vol_file, volume, pos, index, title, paragraphs`` of all volume files."""
        found = _files(self.spark, self.base, "vol-*.json", VOLUME)
        exploded = found.select("source", "slug", F.col("file_name").alias("vol_file"), "volume", F.posexplode("chapters").alias("pos", "c"))
        return exploded.select("source", "slug", "vol_file", "volume", "pos", "c.index", "c.title", "c.paragraphs")

    def stories(self) -> DataFrame:
        """``source, slug, has_index, has_metadata``: every folder that holds one or the other."""
        held = _placed(named.listed(self.spark, self.base, "*.json"), self.base).where("file_name IN ('chapters_index.json', 'metadata.json')")
        return held.groupBy("source", "slug").agg(F.bool_or(F.col("file_name") == "chapters_index.json").alias("has_index"), F.bool_or(F.col("file_name") == "metadata.json").alias("has_metadata"))

    def rebuilt_index(self) -> DataFrame:
        """Index made anew from the volumes: the last file, then the last position wins."""
        rows = volumes.last_written(self.chapters().drop("paragraphs"), ["source", "slug", "index"], "vol_file", "pos")
        return rows.select("source", "slug", "index", "title")

    def list_stories(self) -> DataFrame:
        """Slugs of all sources, the same slug as often as sources have it."""
        return self.stories().select("slug")

    def resolved(self, rows: DataFrame) -> DataFrame:
        """Rows of every slug from the first source (by name) that has it."""
        first = self.stories().groupBy("slug").agg(F.min("source").alias("source"))
        return rows.join(first, ["source", "slug"], "left_semi")

    def _of(self, rows: DataFrame, slug: str) -> DataFrame:
        """Rows of a slug, from the first source (by name) that has it."""
        sources = self.stories().where(F.col("slug") == slug).agg(F.min("source").alias("source"))
        return rows.where(F.col("slug") == slug).join(F.broadcast(sources), "source", "left_semi")

    def get_chapter_index(self, slug: str) -> DataFrame:
        return self._of(self.index(), slug).select("index", "title").orderBy("index")

    def get_story_title(self, slug: str) -> str:
        """Title of a story, its slug if it has none."""
        row = self._of(self.metadata(), slug).select(library.title_or(F.col("story_title"), F.lit(slug)).alias("t")).first()
        return row["t"] if row else slug

    def get_chapter(self, slug: str, index: int, mode: str = "robust", volume_size: int = 50):
        """One chapter as a row with title and paragraphs, or None."""
        chapters = self._of(volumes.last_written(self.chapters(), ["source", "slug", "index"], "vol_file", "pos"), slug).withColumnRenamed("slug", "story")
        listed = self._of(self.index(), slug).withColumnRenamed("slug", "story")
        wanted = self.spark.range(1).select(F.lit(slug).alias("story"), F.lit(index).alias("index"))
        return library.lookup(listed, chapters, wanted, mode, volume_size).where("paragraphs IS NOT NULL").first()

    def get_total_chapters(self, slug: str) -> int:
        """Last index plus one; 0 for an empty or unknown story."""
        row = self._of(self.index(), slug).agg(F.max("index").alias("last")).first()
        return 0 if row["last"] is None else row["last"] + 1


def open_library(spark: SparkSession, base: str) -> Library:
    return Library(spark, base)


def _write(rows: DataFrame, base: str, file_name: Column, content: Column, mode: str = "append") -> None:
    """``<source>/<slug>/<file_name>`` below ``base`` for every row; a null content deletes that file."""
    named.write_named(rows.select(F.concat_ws("/", "source", "slug", file_name).alias("name"), content.alias("content")), base, mode)


def write_volumes(chapters: DataFrame, base: str, mode: str = "append") -> None:
    """Chapters ``source, slug, volume, index, title, paragraphs`` as one file ``vol-NNN-chAAA-BBB.json`` a volume.

    Files appear together when all tasks are done; a volume written again under
    the same name is replaced. A volume's chapters are packed in one row.
    """
    packed = chapters.groupBy("source", "slug", "volume").agg(F.array_sort(F.collect_list(F.struct("index", "title", "paragraphs"))).alias("chapters"))
    ranged = packed.withColumn("chapterRange", F.array(F.element_at("chapters", 1)["index"] + 1, F.element_at("chapters", -1)["index"] + 1))
    file_name = volumes.volume_name(F.col("volume"), F.col("chapterRange")[0], F.col("chapterRange")[1])
    _write(ranged, base, file_name, F.to_json(F.struct("volume", "chapterRange", "chapters")), mode)


def write_index(chapters: DataFrame, base: str) -> None:
    """``chapters_index.json`` of every story that has chapters: a JSON array in order of the chapters."""
    listed = chapters.groupBy("source", "slug").agg(F.array_sort(F.collect_list(F.struct("index", "title"))).alias("chapters"))
    _write(listed, base, F.lit("chapters_index.json"), F.to_json("chapters"))


def write_metadata(stories: DataFrame, base: str) -> None:
    """``metadata.json`` of the stories that have a title; the others' are left as they are."""
    _write(stories.where("story_title IS NOT NULL"), base, F.lit("metadata.json"), F.to_json(F.struct("story_title")))


def write_checkpoints(checkpoints: DataFrame, finished: DataFrame, base: str) -> None:
    """``_progress.json`` of every story in ``checkpoints``, in place of the one before; those of ``finished`` stories are deleted."""
    told = checkpoints.join(finished.select("source", "slug").distinct(), ["source", "slug"], "left_anti")
    content = F.to_json(F.struct("next_url", "next_index", "story_title"))
    gone = finished.select("source", "slug").distinct().withColumn("content", F.lit(None).cast("string"))
    _write(told.select("source", "slug", content.alias("content")).unionByName(gone), base, F.lit("_progress.json"), F.col("content"))


def copied(spark: SparkSession, source: str, target: str) -> None:
    """Every JSON file of the library ``source`` in place of whatever ``target`` held."""
    found = _placed(named.read_bytes(spark, source, "*.json"), source)
    named.write_named(found.select(F.concat_ws("/", "source", "slug", "file_name").alias("name"), "content"), target, "overwrite")


def upserted(old: DataFrame, new: DataFrame, finished: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Checkpoints after an update: of each key the latest by ``order``; those of ``finished`` keys are gone."""
    rest = [c for c in old.columns if c not in keys]
    latest = old.unionByName(new).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")
    return latest.join(finished.select(*keys).distinct(), keys, "left_anti")


def left_to_read(chapters: DataFrame, checkpoints: DataFrame, keys: list[str], index: str, limit: int = 0) -> DataFrame:
    """Chapters from each story's checkpoint on, or all where it names no next address; at most ``limit`` a story, 0 for no limit."""
    begun = checkpoints.where("coalesce(next_url, '') <> ''").select(*keys, F.col("next_index").alias("from_index"))
    rest = chapters.join(begun, keys, "left").where(F.col(index) >= F.coalesce("from_index", F.lit(0))).drop("from_index")
    if not limit:
        return rest
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(index))
    return rest.withColumn("place", place).where(F.col("place") <= limit).drop("place")
