"""Joins of points with the ranges that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(place: Column, level: Column, width: int) -> Column:
    """Number of the bin of ``width`` times two to the ``level`` that holds ``place``."""
    return F.floor(place / (F.lit(width) * F.pow(F.lit(2.0), level))).cast("long")


def within(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, low: str, high: str, width: int = 16) -> DataFrame:
    """Every row of ``points`` with every row of ``ranges`` of equal ``keys`` for which ``low <= point <= high``.

    Bins make it a join on equality. A range goes to the level whose bins are as
    long as itself, of which it touches two at most, however long it is; a point
    goes to one bin of every level that occurs, so there are as many rows of it
    as the lengths of ranges have different binary magnitudes (63 at most), all
    of which reach the driver. Bins are numbers of whole places, so places and
    bounds must be integers; rows with a null in keys, place or bounds and ranges
    whose ``high`` is less than ``low`` meet nothing. Columns of ``ranges`` other
    than keys must have names of their own.
    """
    length = F.greatest(F.lit(1.0), (F.col(high) - F.col(low) + 1) / F.lit(width))
    leveled = ranges.where(F.col(high) >= F.col(low)).withColumn("__level", F.ceil(F.log2(length)).cast("int"))
    levels = sorted(r[0] for r in leveled.select("__level").distinct().collect())
    first, last = (_bin(F.col(c), F.col("__level"), width) for c in (low, high))
    binned = leveled.withColumn("__bin", F.explode(F.sequence(first, last)))
    spread = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__bin", _bin(F.col(point), F.col("__level"), width))
    met = spread.join(binned, [*keys, "__level", "__bin"])
    return met.where((F.col(low) <= F.col(point)) & (F.col(point) <= F.col(high))).drop("__level", "__bin")
