"""State a key over event streams where order decides: a cache whose entries expire and are pushed out, and batches by count.

Micro-batches come in the order of time, as bounded as the source makes them;
within one, the events of a key are put in order, of which only time, id and
name are held. Later micro-batches must not bring earlier events.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that state of several variables needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class AudioCache(StatefulProcessor):
    """Entries live for ``life`` microseconds; of more than ``most`` the oldest insertion goes (0: no bound).

    A hit leaves its entry where it is; reading an expired entry deletes it, so
    writing it anew moves it to the end. All entries live equally long, hence
    expired ones are the oldest insertions: dropping them early, at any read or
    by the timer, changes no hit, and state is never more than the live entries.
    """

    def __init__(self, life: int, most: int) -> None:
        self.life, self.most = life, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", "name string, written bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        live = {name: written for name, written in self.live.get()}  # in the order of insertion
        for at, event_id, name in sorted((r.micros, r.event_id, r.name) for r in rows):
            while live and at - (oldest := next(iter(live.items())))[1] >= self.life:
                del live[oldest[0]]
            hit = name in live
            if not hit:
                live[name] = at
                if self.most and len(live) > self.most:
                    del live[next(iter(live))]
            yield Row(cache=key[0], event_id=event_id, name=name, hit=hit)
        self._keep(live)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1_000
        self._keep({name: written for name, written in self.live.get() if now - written < self.life})
        return iter(())

    def _keep(self, live: dict[str, int]) -> None:
        """State and the one timer, which goes off when the last entry has expired."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if live:
            self.live.put(list(live.items()))
            self.handle.registerTimer((max(live.values()) + self.life) // 1_000 + 1)
        else:
            self.live.clear()

    def close(self) -> None:
        pass


def cache_reads(events: DataFrame, minutes: int = 30, most: int = 200, lateness: str = "0 seconds") -> DataFrame:
    """``cache, event_id, name, hit`` of reads ``cache, ts, event_id, name``, each cache by itself; a miss writes the entry.

    Rows without a cache or a name are left out. ``events`` is a stream.
    """
    _with_store(events.sparkSession)
    timed = events.where("cache IS NOT NULL AND name IS NOT NULL").select("cache", F.col("ts").cast("timestamp").alias("ts"), "event_id", "name")
    timed = timed.withWatermark("ts", lateness).withColumn("micros", F.unix_micros("ts"))
    return timed.groupBy("cache").transformWithState(AudioCache(minutes * 60_000_000, most), "cache string, event_id bigint, name string, hit boolean", "append", "EventTime")


class CountedBatches(StatefulProcessor):
    """Every ``size`` events of a key are a batch; state is how many have been seen."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        for seen, (_, event_id) in enumerate(sorted((r.micros, r.event_id) for r in rows), seen + 1):  # noqa: B020
            yield Row(key=key[0], event_id=event_id, batch=(seen - 1) // self.size)
        self.seen.update((seen,))

    def close(self) -> None:
        pass


def numbered_batches(events: DataFrame, size: int) -> DataFrame:
    """``key, event_id, batch`` of events ``key, ts, event_id``: every ``size`` of a key, in order, are one batch, the last one partial."""
    _with_store(events.sparkSession)
    timed = events.where("key IS NOT NULL").select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id")
    return timed.groupBy("key").transformWithState(CountedBatches(size), "key string, event_id bigint, batch bigint", "append", "None")
