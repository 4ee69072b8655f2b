"""WARC archives: a writer with one gzip member a record, and a reader that splits inside files.

The reader cuts every file into byte ranges. A task looks for gzip's magic bytes
in its range, takes a place for a record only if what is inflated there decodes
as a WARC header, has the stated length and passes gzip's own checksum, and owns
the records that start in its range, reading on past the end of the last one. A
record that holds whole gzip members as they are could mislead a task that
begins inside it; such finds lie within a record that crosses the range's start
and are dropped by a join with those.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from storylake.llm.common import written
from storylake.llm.decontamination import if_small
from storylake.sources.named import StagedWriter, located
from storylake.sources.shared import shared_path

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n\r\n"
#: Bytes of a range, bytes read at a time, and the longest header that a record may have.
SPLIT, BLOCK, HEADER = 64 << 20, 1 << 20, 1 << 16
#: Records are dated by a parameter, so that the same table always gives the same archive.
DATE = "2020-01-01T00:00:00Z"
#: Rows of one output batch, and bytes of payload after which it ends early.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page: str | None) -> str:
    return "<urn:x-page:null>" if page is None else f"<urn:x-page:id:{urllib.parse.quote(page, safe='')}>"


def page_of(name: str | None) -> str | None:
    found = re.fullmatch(r"<urn:x-page:id:(.*)>", name or "")
    return urllib.parse.unquote(found[1]) if found else None


def _header(lines: list[tuple[str, str | None]]) -> bytes:
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", v)  # noqa: E731  a line break would end the field
    return "".join(f"{k}: {clean(v)}\r\n" for k, v in lines if v is not None).encode("utf-8", "surrogatepass")


def record(page: str | None, url: str | None, payload: bytes, kind: str, first: str | None, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    revisit = [("WARC-Refers-To", urn(first)), ("WARC-Profile", PROFILE)] if kind == "revisit" else []
    lines = [("WARC-Type", kind), ("WARC-Record-ID", urn(page)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), *revisit]
    return b"WARC/1.1\r\n" + _header([*lines, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]) + b"\r\n" + block + BREAK


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class WarcWriter(StagedWriter):
    """Rows ``page, url, payload, kind, first`` of one task as one archive; tasks without rows write none."""

    def write_files(self, batches, stage):
        out = None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page", "url", "payload", "kind", "first"))
            for page, url, payload, kind, first in zip(*columns):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = stage(name)
                    info = b"format: WARC File Format 1.1\r\n"
                    lines = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-archive:{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]
                    out.write(member(b"WARC/1.1\r\n" + _header(lines) + b"\r\n" + info + BREAK))
                out.write(member(record(page, url, payload, kind, first)))
        if out is not None:
            out.close()
        return iter(())


class WarcArchive(DataSource):
    """The sink ``warc``: archives below ``path``, published when all tasks are done."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "page string, url string, payload binary, kind string, first string"

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


class Bytes:
    """A file read in blocks, of which the last is kept."""

    def __init__(self, file) -> None:
        self.file, self.size, self.start, self.block = file, file.size(), 0, b""

    def at(self, place: int, size: int) -> bytes:
        if not self.start <= place or place + size > self.start + len(self.block):
            self.start, self.block = place, self.file.read_at(max(BLOCK, size), place) if place < self.size else b""
        return self.block[place - self.start : place - self.start + size]

    def find(self, place: int, end: int) -> int | None:
        """The first magic bytes that start in ``[place, end)``."""
        while place < end:
            data = self.at(place, min(BLOCK, end - place + 2))
            found = data.find(MAGIC)
            if found >= 0 and place + found < end:
                return place + found
            if len(data) < 3:
                return None
            place += len(data) - 2
        return None


def decoded(file: Bytes, place: int) -> tuple[int, dict[str, str], bytes] | None:
    """The record at ``place``, its end and its header, if a whole and valid one is there."""
    unpack, parts, at, size, head = zlib.decompressobj(31), [], place, 4_096, b""
    try:
        while not unpack.eof:
            data = file.at(at, size)
            if not data:
                return None
            parts.append(unpack.decompress(data))
            at, size = at + len(data), min(2 * size, BLOCK)
            if len(head) < HEADER and BREAK not in head:
                head += parts[-1][:HEADER]
                if not b"WARC/1.".startswith(head[:7]) or BREAK not in head and len(head) >= HEADER:
                    return None
    except zlib.error:
        return None
    whole = b"".join(parts)
    top, _, rest = whole.partition(BREAK)
    lines = top.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = fields.get("content-length", "")
    if not lines[0].startswith("WARC/1.") or not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(BREAK):
        return None
    return at - len(unpack.unused_data), fields, rest[:-4]


def records_of(file: Bytes, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Start, end, header and block of the records that start in ``[start, end)``."""
    place = file.find(start, end)
    while place is not None:
        found = decoded(file, place)
        if found:
            yield place, *found
        place = file.find(found[0] if found else place + 1, end)


def _row(path: str, place: int, end: int, fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    http, _, payload = block.partition(BREAK)
    kind, length = fields.get("warc-type"), re.search(rb"(?im)^content-length:\s*(\d+)", http)
    digest = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    if kind != "response":
        return path, place, end, kind, page_of(fields.get("warc-record-id")), page_of(fields.get("warc-refers-to")), fields.get("warc-target-uri"), int(length[1]) if length else None, digest, None, None
    own = sha1_base32(payload)
    return path, place, end, kind, page_of(fields.get("warc-record-id")), None, fields.get("warc-target-uri"), len(payload), own, digest == own, payload if payloads else None


RECORDS = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("page", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary())]
)


def read_warc(spark: SparkSession, path: str, payloads: bool = True, split: int = SPLIT) -> DataFrame:
    """Every record of the archives below ``path``.

    ``file, offset, end, type, page, refers_to, url, payload_bytes,
    payload_digest, intact, payload``. Length and digest are those of the full
    payload: of a response as computed from what was read (``intact`` tells
    whether its header agrees), of a revisit as its header states them. Bytes
    between records, members that hold no record and broken members are passed
    over. An empty folder gives no rows.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc.gz").load(path).where("length > 0")
    cut = listed.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = written(cut, "warc_ranges")
    tasks = max(1, ranges.count())

    def run(batches):
        rows, size = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORDS)], schema=RECORDS)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, inner = located(name)
                with files.open_input_file(inner) as source:
                    for found in records_of(Bytes(source), start, start + split):
                        rows.append(_row(name, *found, payloads))
                        size += len(rows[-1][-1] or b"")
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield flush()
                            rows, size = [], 0
        if rows:
            yield flush()

    kinds = "file string, offset bigint, end bigint, type string, page string, refers_to string, url string, payload_bytes bigint, payload_digest string, intact boolean, payload binary"
    return ranges.repartition(tasks).mapInArrow(run, kinds)


def outermost(records: DataFrame, split: int = SPLIT) -> DataFrame:
    """``records`` without those found inside a record that crosses into their range; the crossing ones are few, a range each.

    ``records`` is read twice: give a written table.
    """
    at = lambda c: F.floor(F.col(c) / split)
    over = records.where(at("offset") < F.floor((F.col("end") - 1) / split))
    crossing = over.select("file", F.col("offset").alias("__from"), F.col("end").alias("__to"), F.explode(F.sequence(at("offset") + 1, F.floor((F.col("end") - 1) / split))).alias("__range"))
    found = records.withColumn("__at", at("offset"))
    inside = (F.col("file") == F.col("__file")) & (F.col("__at") == F.col("__range")) & (F.col("offset") > F.col("__from")) & (F.col("offset") < F.col("__to"))
    return found.join(if_small(crossing.withColumnRenamed("file", "__file")), inside, "left_anti").drop("__at")


def marked(pages: DataFrame, page: Column, html: Column, least: int) -> DataFrame:
    """``pages`` with ``kind`` and ``first``: of equal payloads of ``least`` bytes the row of least id is the response."""
    key = F.sha2(html, 256)
    firsts = pages.where(F.octet_length(html) >= least).groupBy(key.alias("__key")).agg(F.min(page).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    joined = pages.withColumn("__own", F.when(F.octet_length(html) >= least, key)).join(if_small(firsts), F.col("__own") == F.col("__key"), "left")
    again = F.col("__first").isNotNull() & ~page.eqNullSafe(F.col("__first"))
    return joined.withColumns({"kind": F.when(again, "revisit").otherwise("response"), "first": F.when(again, F.col("__first"))}).drop("__own", "__key", "__first")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, mode: str = "append") -> None:
    """Write one record for every row of ``pages`` below ``path``.

    A null html is an empty payload, a null url leaves its field out, control
    characters in a url are escaped. Of rows with equal payloads of ``least``
    bytes or more that of least id is the response and the others revisit it;
    rows that share this id are all responses, and so are all rows of a payload
    whose ids are all null. An empty table writes no archive.
    """
    pages.sparkSession.dataSource.register(WarcArchive)
    rows = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    told = marked(rows, F.col("page"), F.col("html"), least)
    told.select(F.col("page").cast("string"), "url", F.col("html").cast("binary").alias("payload"), "kind", F.col("first").cast("string")).write.format("warc").mode(mode).save(path)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, split: int = SPLIT) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, intact`` as read back from archives of ``pages``.

    Nulls, ties, repeated rows and empty tables as :func:`write_warc` says; one
    row for every row of ``pages``, whose columns may have any name.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    path = shared_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, html_col, least)
    read = outermost(written(read_warc(spark, path, False, split).drop("payload"), "warc_records"), split)
    told = read.where(F.col("type").isin("response", "revisit"))
    return told.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"), "intact")
