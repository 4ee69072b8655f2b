"""What a player derives from its place: rates, jumps, the range read, what to fetch ahead, audio in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rates to choose from, seconds after which going back starts the chunk anew, chunks fetched ahead.
RATES = (0.75, 1.0, 1.25, 1.5, 2.0)
RESTART_SECONDS, AHEAD = 3, 5


def rate(place: Column) -> Column:
    """The rate at a place of the list, around its end."""
    return F.element_at(F.array(*map(F.lit, RATES)), (F.pmod(place, F.lit(len(RATES))) + 1).cast("int"))


def back_target(chunk: Column, elapsed: Column) -> Column:
    """The chunk to go back to: the same if it has played for a while, else the one before, 0 at least."""
    return F.when(elapsed > RESTART_SECONDS, chunk).otherwise(F.greatest(chunk - 1, F.lit(0)))


def forward_target(chunk: Column, total: Column) -> Column:
    """The next chunk; the last one stays."""
    return F.when(chunk + 1 < total, chunk + 1).otherwise(chunk)


def is_active(paragraph: Column, chunk: Column) -> Column:
    """Whether a paragraph lies in the chunk's range."""
    return paragraph.between(chunk["start_idx"], chunk["end_idx"])


def fetched_ahead(chunk: Column, total: Column) -> Column:
    """Chunks to fetch while this one plays."""
    last = F.least(chunk + AHEAD, total - 1)
    return F.when(last > chunk, F.sequence(chunk + 1, last)).otherwise(F.array().cast("array<int>"))


def still_held(key: Column, chunk: Column) -> Column:
    """Whether a fetched chunk is kept: the one before the present and all later ones."""
    return key >= chunk - 1


def in_order(parts: DataFrame, key: str, order: str, part: str) -> DataFrame:
    """``key, joined``: the parts of every key put together in their order, however they were made; null if one failed."""
    listed = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(part).alias("p")))).alias("l"))
    return listed.select(key, F.when(~F.exists("l", lambda x: x["p"].isNull()), F.array_join(F.transform("l", lambda x: x["p"]), "")).alias("joined"))
