"""Importance resampling of a corpus towards a target, on hashed n-grams.

Tasks hand their texts to a DuckDB connection of their own, whose SQL unnests
words, joins neighbours by a window, hashes each n-gram by a registered zlib
CRC function and counts buckets. Counts go to Parquet through Spark's committer,
so a lost executor leaves no half counts; Spark adds the buckets of all tasks up
and scores every document by its own. The draw is by Gumbel top-k: score plus
noise from a hash of the id, highest first, without any collect or global sort.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storylake.llm.common import UPPER, written

BUCKETS = 10_000
#: Code points of text that one statement sees; a longer text goes in pieces that share one word.
SLICE = 1 << 19
#: Bucket counts after which a task hands its rows on.
HELD = 1 << 18
BREAK = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = str.maketrans(UPPER, UPPER.lower())
SETTINGS = {"threads": 1, "memory_limit": "200MB", "preserve_insertion_order": False}
#: ``carried`` pieces begin with the last word of the piece before, which has been counted there.
COUNT = r"""
    WITH texts AS (SELECT row, carried, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM pieces),
    placed AS (SELECT row, carried, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts),
    grams AS (
        SELECT row, word AS gram FROM placed WHERE NOT carried OR place > 1
        UNION ALL
        SELECT row, word || ' ' || next FROM (SELECT row, word, lead(word) OVER (PARTITION BY row ORDER BY place) AS next FROM placed) WHERE next IS NOT NULL)
    SELECT row, zlib_crc32(gram) % {buckets} AS bucket, count(*) AS n FROM grams GROUP BY ALL ORDER BY ALL"""


def crc_of(grams: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Unsigned CRC-32 of the UTF-8 bytes of every string, read from Arrow's own buffers."""
    found: list[int] = []
    for part in grams.chunks if isinstance(grams, pa.ChunkedArray) else [grams]:
        part = part.cast(pa.large_string())
        at = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1].tolist()
        data = memoryview(part.buffers()[2]) if part.buffers()[2] is not None else memoryview(b"")
        found += [zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])]
    return pa.array(found, pa.int64())


class Counter:
    """One task's DuckDB connection."""

    def __init__(self, buckets: int) -> None:
        self.connection = duckdb.connect(config=SETTINGS)
        self.connection.create_function("zlib_crc32", crc_of, ["VARCHAR"], "BIGINT", type="arrow")
        self.statement = COUNT.format(upper=UPPER, lower=UPPER.lower(), buckets=buckets)

    def close(self) -> None:
        """Workers serve many tasks; a connection left open would hold its memory beyond its own."""
        self.connection.remove_function("zlib_crc32")
        self.connection.close()

    def __call__(self, rows: list[int], texts: list[str], carried: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, bucket and count, ordered by row and bucket."""
        pieces = pa.table({"row": pa.array(rows, pa.int64()), "text": pa.array(texts, pa.large_string()), "carried": pa.array(carried, pa.bool_())})
        self.connection.register("pieces", pieces)
        found = self.connection.sql(self.statement).to_arrow_table()
        self.connection.unregister("pieces")
        return tuple(found.column(c).to_numpy() for c in ("row", "bucket", "n"))


def pieces_of(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """The text in pieces of about ``size`` code points, cut between words; each but the first begins with the last word before it."""
    text, at, before = text.translate(LOWERED), 0, ""
    while at < len(text):
        end = BREAK.search(text, min(len(text), at + size))
        stop = end.end() if end else len(text)
        piece = text[at:stop]
        yield (f"{before} {piece}", True) if before else (piece, False)
        back = size
        while True:  # the last word of the piece; a word may be longer than any tail
            start = max(0, len(piece) - back)
            found = [m for m in WORD.finditer(piece, start) if m.start() > start or not start]
            if found or not start:
                break
            back *= 4
        before, at = found[-1].group() if found else before, stop


def counted(count: Counter, texts: Iterable[str | None], buckets: int, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets (ascending) and counts of every text, in order; a null has none. A statement's texts are all that is held."""
    held, chars = [], 0

    def together():
        row, bucket, n = count(list(range(len(held))), held, [False] * len(held))
        edges = np.searchsorted(row, np.arange(len(held) + 1))
        return [(bucket[a:b], n[a:b]) for a, b in zip(edges, edges[1:])]

    for text in texts:
        text = text or ""
        if held and chars + len(text) > size:
            yield from together()
            held, chars = [], 0
        if len(text) <= size:
            held.append(text)
            chars += len(text)
            continue
        whole = np.zeros(buckets, np.int64)
        for piece, carried in pieces_of(text, size):
            _, bucket, n = count([0], [piece], [carried])
            whole[bucket] += n
        there = np.flatnonzero(whole)
        yield there, whole[there]
    if held:
        yield from together()


def bucket_counts(df: DataFrame, id_col: str, text_col: str, label: str, buckets: int = BUCKETS) -> DataFrame:
    """``id, whole, buckets, counts`` of every row and, with ``whole`` true and a null id, the sums of every task; written as Parquet."""
    kept = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = kept.schema["id"].dataType.simpleString()

    def batch_of(ids, rows, whole):
        offsets = pa.array(np.cumsum([0, *(len(b) for b, _ in rows)]), pa.int32())
        joined = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in (0, 1)]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(joined[0].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(joined[1].astype(np.int64)))]
        return pa.RecordBatch.from_arrays([ids, pa.array([whole] * len(rows), pa.bool_()), *lists], names=["id", "whole", "buckets", "counts"])

    def run(batches):
        count, total, id_type = Counter(buckets), np.zeros(buckets, np.int64), None
        for batch in batches:
            id_type, rows, first, held = batch.column(0).type, [], 0, 0
            for bucket, n in counted(count, (t.as_py() for t in batch.column(1)), buckets):
                total[bucket] += n
                rows.append((bucket.astype(np.int32), n))
                held += len(n)
                if held >= HELD:
                    yield batch_of(batch.column(0).slice(first, len(rows)), rows, False)
                    first, rows, held = first + len(rows), [], 0
            if rows:
                yield batch_of(batch.column(0).slice(first, len(rows)), rows, False)
        count.close()
        there = np.flatnonzero(total)
        if len(there):
            yield batch_of(pa.nulls(1, id_type), [(there, total[there])], True)

    return written(kept.mapInArrow(run, f"id {kind}, whole boolean, buckets array<int>, counts array<bigint>"), label)


def totals(counts: DataFrame) -> dict[int, int]:
    """The sum of every bucket over all tasks: as many numbers as there are buckets reach the driver."""
    parts = counts.where("whole").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return {r["b"]: r["n"] for r in parts.groupBy(F.col("x.buckets").alias("b")).agg(F.sum("x.counts").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Of every bucket floor(1000 ln of the ratio of its smoothed shares in target and source)."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, of in ((s, source), (t, target)):
        into[list(of)] = list(of.values())
    up, down = (t + 1).astype(float) * float(s.sum() + buckets), (s + 1).astype(float) * float(t.sum() + buckets)
    return np.floor(1000 * np.log(up / down)).astype(np.int64).tolist()


def weighed(counts: DataFrame, gain: list[int]) -> DataFrame:
    """``id, n_features, gain`` of every document row of ``counts``: its features and the sum of their gains."""
    rows = counts.where("NOT whole").select("id", "buckets", "counts")
    fixed = np.array(gain, np.int64)

    def run(batches):
        for batch in batches:
            n = batch.column(2).flatten().to_numpy()
            each = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * fixed[batch.column(1).flatten().to_numpy()])])
            edges = batch.column(2).offsets.to_numpy()
            edges = edges - edges[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.diff(e[edges])) for e in each)], names=["id", "n_features", "gain"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_features bigint, gain bigint")


def scored(counts: DataFrame, gain: list[int], salt: str) -> DataFrame:
    """``doc_id, n_features, weight, score`` of every document row of ``counts``."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0).cast("bigint"))
    rows = weighed(counts, gain).select(F.col("id").alias("doc_id"), "n_features", mean.alias("weight"), noise.alias("h"))
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((F.col("h") + 0.5) / F.lit(4294967296.0))))
    return rows.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel).alias("score"))


def ranked(rows: DataFrame, order: str, ties: list[str], percent: int) -> DataFrame:
    """``rows`` with the ``rank`` of the ``percent`` per cent of highest ``order``; null beyond and where ``order`` is null.

    Ranks need no global sort: rows are ranked among those of the same value, of
    which noise from a hash leaves few, and a value begins where the counts of
    all higher ones end. Those are added up in two steps, within ranges of 256
    values and over the ranges.
    """
    able = rows.where(F.col(order).isNotNull())
    sizes = able.groupBy(F.col(order).alias("value")).agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("value") / 256))
    over = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.groupBy("span").agg(F.sum("n").alias("n")).select("span", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    within = Window.partitionBy("span").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(spans, "span").select(F.col("value").alias(order), (F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"), "all")
    among = Window.partitionBy(order).orderBy(*(F.col(c).asc_nulls_last() for c in ties))
    placed = able.withColumn("among", F.row_number().over(among)).join(starts, order)
    rank = (F.col("before") + F.col("among")).cast("bigint")
    drawn = placed.select(*rows.columns, F.when(rank <= F.expr(f"`all` * {percent} div 100"), rank).alias("rank"))
    return drawn.unionByName(rows.where(F.col(order).isNull()).withColumn("rank", F.lit(None).cast("bigint")))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", percent: int = 25, least_words: int = 20, salt: str = "7"
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``.

    Null and empty texts have no features, weight 0 and are never drawn, like
    all of fewer than ``least_words`` words. Texts of any length are counted
    whole. A null id gets noise from an empty one and comes last among equals;
    repeated rows are scored and drawn one by one. An empty target leaves all
    shares smoothed; empty ``docs`` give no rows. Columns may have any name.
    """
    counts = bucket_counts(docs, id_col, text_col, "importance")
    gain = gains(totals(counts), totals(bucket_counts(target, target_id, target_text, "importance_target")))
    rows = written(scored(counts, gain, salt), "importance_scores")
    eligible = F.col("n_features") >= 2 * least_words - 1
    found = ranked(rows.withColumn("key", F.when(eligible, F.col("score"))), "key", ["doc_id", "n_features", "weight"], percent)
    return found.select("doc_id", "n_features", "weight", "score", "rank")
