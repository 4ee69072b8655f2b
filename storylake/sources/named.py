"""Files under names of the caller's choice, written by tasks and published together, and read by any name.

Spark's own writers name their files themselves. Here every task attempt writes
into a staging folder of its own and tells the names in a table; when all tasks
are done and no name is given twice, tasks move the files of that table to their
places. A failed task, a repeated attempt or a failed job leaves nothing under
the final names. Folders are listed by tasks too, level by level, so that neither
names nor contents pass through the driver. Spark's readers pass over names with a
leading underscore or dot; the reader here takes them. Paths may lie in any file
system that Arrow knows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from storylake.sources.shared import settled

#: Files moved at a time when a job is committed.
MOVES = 16
#: Files and bytes that one task reads on average, and that it hands on at a time at least; names likewise.
TASK_FILES, TASK_BYTES = 1_000, 64 << 20
BATCH_FILES, BATCH_BYTES = 256, 4 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of ``path`` and the path in it; ``file:/x``, as Spark says it, is ``file:///x``."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Staged(WriterCommitMessage):
    """What one task attempt wrote: staged path by final name, and names that are to go."""

    files: dict[str, str] = field(default_factory=dict)
    gone: list[str] = field(default_factory=list)


class StagedWriter(DataSourceArrowWriter):
    """For jobs of few files a task: stage in the tasks, publish on commit; kinds of files differ in :meth:`write_files`."""

    def __init__(self, base: str, overwrite: bool) -> None:
        self.base, self.overwrite, self.job = base.rstrip("/"), overwrite, uuid.uuid4().hex

    def write_files(self, batches: Iterator[pa.RecordBatch], stage) -> Iterator[str]:
        """Write the rows of one task with ``stage(name)``, which opens a file for bytes; yield names to delete."""
        raise NotImplementedError

    @property
    def staging(self) -> str:
        return f"_staged-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, root = located(self.base)
        mine, done = f"{root}/{self.staging}/{uuid.uuid4().hex}", Staged()

        def stage(name: str):
            if name in done.files or name.startswith(("/", "_staged-")) or ".." in name.split("/"):
                raise ValueError(f"not a name, or named twice: {name}")
            done.files[name] = staged = f"{mine}/{len(done.files)}"
            return files.open_output_stream(staged, compression=None)

        files.create_dir(mine, recursive=True)
        done.gone.extend(self.write_files(iterator, stage))
        return done

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = located(self.base)
        told = [m for m in messages if m]
        names = [n for m in told for n in m.files]
        if len(set(names)) < len(names):
            raise ValueError(f"named by two tasks: {sorted(n for n in set(names) if names.count(n) > 1)[:3]}")
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if not old.base_name.startswith("_staged-"):
                    files.delete_dir(old.path) if old.type == fs.FileType.Directory else files.delete_file(old.path)
        for folder in {n.rpartition("/")[0] for n in names} - {""}:
            files.create_dir(f"{root}/{folder}", recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda move: files.move(move[0], f"{root}/{move[1]}"), [(staged, n) for m in told for n, staged in m.files.items()]))
            gone = [n for m in told for n in m.gone if n not in set(names)]
            list(pool.map(files.delete_file, [i.path for i in files.get_file_info([f"{root}/{n}" for n in gone]) if i.type == fs.FileType.File]))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """Drop the staging folder; what an attempt that is still running writes there later, no reader takes up."""
        files, root = located(self.base)
        with suppress(OSError):
            files.delete_dir(f"{root}/{self.staging}")


def _whole(count: int, each: int) -> int:
    return max(1, -(-count // each))


def write_named(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write ``name, content`` rows as one file each below ``path``; a null content deletes the file of that name.

    ``append`` keeps other files, ``overwrite`` doesn't. Null names are an error. Contents are spread over
    ``spark.sql.shuffle.partitions`` tasks, since files cost more than their bytes.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode is append or overwrite, not {mode}")
    spark, base, staging = rows.sparkSession, path.rstrip("/"), f"_staged-{uuid.uuid4().hex}"
    files, root = located(base)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = located(base)
        mine, written = f"{staging}/{uuid.uuid4().hex}", 0
        for batch in batches:
            names, staged = batch.column("name").to_pylist(), []
            for name, content in zip(names, batch.column("content")):
                if name is None or name.startswith(("/", "_staged-")) or ".." in name.split("/"):
                    raise ValueError(f"not a name: {name}")
                if not content.is_valid:
                    staged.append(None)
                    continue
                if not written:
                    files.create_dir(f"{root}/{mine}", recursive=True)
                staged.append(f"{mine}/{written}")
                with files.open_output_stream(f"{root}/{staged[-1]}", compression=None) as out:
                    out.write(content.as_buffer())
                written += 1
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "staged": pa.array(staged, pa.string())})

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = located(base)
        made = set()
        is_file = lambda at: files.get_file_info(at).type == fs.FileType.File
        for batch in batches:
            for name, staged in zip(batch.column("name").to_pylist(), batch.column("staged").to_pylist()):
                target = f"{root}/{name}"
                if staged is None:
                    with suppress(FileNotFoundError):
                        if is_file(target):
                            files.delete_file(target)
                    continue
                if (folder := target.rpartition("/")[0]) not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                try:
                    files.move(f"{root}/{staged}", target)
                except FileNotFoundError:
                    if is_file(f"{root}/{staged}") or not is_file(target):  # else an earlier attempt of this task moved it
                        raise
            yield pa.RecordBatch.from_pydict({"name": pa.array([], pa.string())})

    try:
        spread = rows.select("name", F.col("content").cast("binary").alias("content")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
        told = settled(spread.mapInArrow(stage, "name string, staged string"), "names")
        once = told.repartition(_whole(told.count(), TASK_FILES), "name").groupBy("name").agg(F.count("staged").alias("n"), F.max("staged").alias("staged"))
        if twice := [r["name"] for r in once.where("n > 1").limit(3).collect()]:
            raise ValueError(f"named twice: {sorted(twice)}")
        if mode == "overwrite":
            for old in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if not old.base_name.startswith("_staged-"):
                    files.delete_dir(old.path) if old.type == fs.FileType.Directory else files.delete_file(old.path)
        once.select("name", "staged").mapInArrow(publish, "name string").write.format("noop").mode("overwrite").save()
    finally:
        # What an attempt that is still running writes there later, no reader takes up.
        with suppress(OSError):
            files.delete_dir(f"{root}/{staging}")


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``name, size`` of every file below ``path`` whose last name matches ``pattern``; of none where there is no folder."""
    base = path.rstrip("/")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = located(base)
        root = root.rstrip("/")
        shown = lambda rows: pa.RecordBatch.from_pylist(rows, pa.schema([("name", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())]))
        rows = []
        for batch in batches:
            for name in batch.column("name").to_pylist():
                for info in files.get_file_info(fs.FileSelector(f"{root}/{name}".rstrip("/"), allow_not_found=True)):
                    folder = info.type == fs.FileType.Directory
                    if not info.base_name.startswith("_staged-") if folder else info.type == fs.FileType.File and fnmatchcase(info.base_name, pattern):
                        rows.append({"name": info.path[len(root) + 1 :], "size": info.size or 0, "folder": folder})
                    if len(rows) >= 10 * BATCH_FILES:
                        yield shown(rows)
                        rows = []
        yield shown(rows)

    level, tasks, found = spark.range(1).select(F.lit("").alias("name")), 1, None
    while tasks:
        seen = settled(level.repartition(tasks).mapInArrow(look, "name string, size long, folder boolean"), "listing")
        here = seen.where("NOT folder").select("name", "size")
        found, level = here if found is None else found.unionByName(here), seen.where("folder").select("name")
        folders = level.count()
        tasks = folders and _whole(folders, TASK_FILES)
    return found


def read_bytes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``name, content`` of the files of :func:`listed`, contents as bytes."""
    base, found = path.rstrip("/"), listed(spark, path, pattern)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = located(base)
        names, contents, size = [], [], 0
        shown = lambda: pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "content": pa.array(contents, pa.binary())})
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with files.open_input_stream(f"{root}/{name}", compression=None) as source:
                    contents.append(source.read())
                names.append(name)
                size += len(contents[-1])
                if len(names) >= BATCH_FILES or size >= BATCH_BYTES:
                    yield shown()
                    names, contents, size = [], [], 0
        yield shown()

    total = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return found.select("name").repartition(max(_whole(total["n"], TASK_FILES), _whole(total["size"], TASK_BYTES))).mapInArrow(read, "name string, content binary")


def read_named(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``name, content`` of the files below ``path`` whose last name matches ``pattern``, hidden ones too; bytes that are no UTF-8 are replaced."""
    return read_bytes(spark, path, pattern).select("name", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
