"""Speech-sized chunks: sentences packed greedily, and the way back from paragraph to chunk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storylake.functions.text import bound, sentences, single_spaced, utf16_length

MIN_CHARS, MAX_CHARS = 450, 1400
_RANGE = "struct<first:int,last:int,start_idx:int,end_idx:int>"


def numbered_sentences(paragraphs: Column) -> Column:
    """``array<struct<p, s, n, opens>>``: the sentences of all paragraphs, the paragraph they stand in, their size, and whether they open it."""
    return F.flatten(F.transform(paragraphs, lambda p, i: F.transform(sentences(single_spaced(p)), lambda s, j: F.struct(i.alias("p"), s.alias("s"), utf16_length(s).alias("n"), (j == 0).alias("opens")))))


def _ranges(items: Column) -> Column:
    """``array<struct<first, last, start_idx, end_idx>>``: which sentences (from 0) and paragraphs each chunk holds.

    One fold; it carries numbers, and a range a finished chunk, but no text.
    """
    start = F.struct(F.array().cast(f"array<{_RANGE}>").alias("done"), F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("size"), F.lit(-1).alias("start_idx"), F.lit(-1).alias("end_idx"))
    emitted = lambda acc: F.array(F.struct(acc["first"].alias("first"), (acc["at"] - 1).alias("last"), acc["start_idx"].alias("start_idx"), acc["end_idx"].alias("end_idx")))

    def step(acc, item):
        size = acc["size"] + F.when(item["opens"], 2).otherwise(1) + item["n"]
        flush = (acc["at"] > 0) & (size > MAX_CHARS) & (acc["size"] >= MIN_CHARS)

        def moved(flushed):
            fresh = flushed | (acc["at"] == 0)
            return F.struct(
                F.when(flushed, F.concat(acc["done"], emitted(acc))).otherwise(acc["done"]).alias("done"),
                (acc["at"] + 1).alias("at"),
                F.when(fresh, acc["at"]).otherwise(acc["first"]).alias("first"),
                F.when(fresh, item["n"]).otherwise(size).alias("size"),
                F.when(fresh, item["p"]).otherwise(acc["start_idx"]).alias("start_idx"),
                item["p"].alias("end_idx"),
            )

        return bound(flush, moved)

    return F.aggregate(items, start, step, lambda acc: F.when(acc["at"] > 0, F.concat(acc["done"], emitted(acc))).otherwise(acc["done"]))


def ranges(paragraphs: Column) -> Column:
    """The chunks of :func:`chunks` without their texts."""
    return _ranges(numbered_sentences(paragraphs))


def chunks(paragraphs: Column) -> Column:
    """Chunks of a text as ``array<struct<text, start_idx, end_idx>>``.

    A sentence joins the buffer with a space within a paragraph and a blank line
    between paragraphs. The buffer is emitted before a sentence that would take
    it past ``MAX_CHARS``, if it has ``MIN_CHARS`` already; lengths count UTF-16
    units. Texts are joined once, when the ranges are known.
    """
    led = lambda x, i: F.when(i == 0, x["s"]).otherwise(F.concat(F.when(x["opens"], "\n\n").otherwise(" "), x["s"]))

    def joined(items):
        text = lambda r: F.array_join(F.transform(F.slice(items, r["first"] + 1, r["last"] - r["first"] + 1), led), "")
        return F.transform(_ranges(items), lambda r: F.struct(text(r).alias("text"), r["start_idx"].alias("start_idx"), r["end_idx"].alias("end_idx")))

    return bound(numbered_sentences(paragraphs), joined)


def chunk_of(found: Column, paragraph: Column) -> Column:
    """Number of the first chunk, or range, that holds the paragraph, or -1."""
    inside = F.transform(found, lambda c: (c["start_idx"] <= paragraph) & (paragraph <= c["end_idx"]))
    return F.coalesce(F.array_position(inside, True), F.lit(0)).cast("int") - 1
