"""What an audio cache would hold: keys, retention, expiry, one computation a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_MINUTES, MOST = 30, 200


def cache_key(rate: Column, text: Column) -> Column:
    """``rate:text``; whole rates without a decimal point."""
    shown = F.when(rate == F.floor(rate), F.floor(rate).cast("string")).otherwise(rate.cast("string"))
    return F.concat(shown, F.lit(":"), text)


def retained(inserts: DataFrame, key: str, ts: str, tie: str, most: int = MOST) -> DataFrame:
    """The keys that a cache of ``most`` entries holds in the end: last in by first insertion.

    Writing a key again doesn't move it. The order is global, so the first
    insertions are aggregated by key before the top ``most`` are taken.
    """
    first = inserts.groupBy(key).agg(F.min(F.struct(ts, tie)).alias("first"))
    return first.orderBy(F.desc("first")).limit(most).select(key, F.col(f"first.{ts}").alias("first_ts"))


def expired(inserts: DataFrame, key: str, ts: str, now: Column, minutes: int = TTL_MINUTES) -> DataFrame:
    """Every key with its last expiry and whether it has passed by ``now``."""
    last = inserts.groupBy(key).agg((F.max(ts) + F.expr(f"INTERVAL {minutes} MINUTES")).alias("expires_at"))
    return last.withColumn("expired", F.col("expires_at") <= now)


def single_flight(requests: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """Requests with ``computes``: whether they start a computation or share one begun less than ``seconds`` before.

    A computation takes ``seconds``; requests of one key are cut into flights
    where the gap to the one before reaches that long.
    """
    order = Window.partitionBy(key).orderBy(ts, tie)
    gap = F.col(ts) - F.lag(ts).over(order)
    return requests.withColumn("computes", F.coalesce(gap >= F.expr(f"INTERVAL '{seconds}' SECOND"), F.lit(True)))
