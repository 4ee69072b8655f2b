"""Streams that are killed and go on; a cache with life and bound against a plain one."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storylake.streaming import progress, stateful

START = datetime(2024, 1, 1)


def plain_cache(events, minutes, most):
    """The cache as a reader and a writer of one map would keep it."""
    caches, out = {}, []
    for ts, event_id, cache, name in sorted(events):
        held = caches.setdefault(cache, {})
        if name in held and held[name] + timedelta(minutes=minutes) <= ts:
            del held[name]
        out.append((cache, event_id, name, name in held))
        if name not in held:
            held[name] = ts
            while len(held) > most:
                del held[next(iter(held))]
    return sorted(out)


@pytest.fixture(scope="module")
def events():
    rnd = random.Random(6)
    return [(START + timedelta(seconds=rnd.randrange(40_000)), i, rnd.choice("ab"), f"n{rnd.randrange(30)}") for i in range(900)]


def table(spark, events):
    return spark.createDataFrame(events, "ts timestamp, event_id long, cache string, name string")


@pytest.mark.parametrize("minutes, most", [(30, 200), (60, 9), (600, 12)])
def test_cache_with_life_and_bound(spark, events, tmp_path, minutes, most):
    stream = progress.in_order(table(spark, events), "ts", 5, str(tmp_path / "in"))
    found = progress.drained(stateful.cache_reads(stream, minutes, most), "append", str(tmp_path / "out"))
    assert sorted(map(tuple, found.collect())) == plain_cache(events, minutes, most)
    assert found.inputFiles() and len({f.split("batch_id=")[1].split("/")[0] for f in found.inputFiles()}) >= 5


def test_a_stream_killed_between_write_and_commit_goes_on(spark, events, tmp_path):
    rows = table(spark, events).withColumn("key", F.col("cache"))
    stream = lambda: stateful.numbered_batches(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d").parquet(str(tmp_path / "in")), 50)
    progress.in_order(rows, "ts", 5, str(tmp_path / "in"))
    kept = progress.Resumable(spark, str(tmp_path / "out"))

    def dying(batch, number):
        kept.write(batch, number)
        if number == 2:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        kept.run(stream(), "append", dying)
    assert 0 < kept.rows(stream().schema).count() < 900
    kept.run(stream())
    expected = []
    for cache in "ab":
        ids = [e[1] for e in sorted(events) if e[2] == cache]
        expected += [(cache, i, n // 50) for n, i in enumerate(ids)]
    assert sorted(map(tuple, kept.rows(stream().schema).collect())) == sorted(expected)
    kept.run(stream())  # nothing new: nothing changes
    assert kept.rows(stream().schema).count() == 900
    late = [(START + timedelta(days=1, seconds=i), 1_000 + i, "a", "x", "a") for i in range(3)]
    spark.createDataFrame(late, rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept.run(stream())
    n = sum(e[2] == "a" for e in events)
    assert sorted(r.batch for r in kept.rows(stream().schema).where("event_id >= 1000").collect()) == [(n + i) // 50 for i in range(3)]


def test_complete_results_are_those_of_the_last_batch(spark, events, tmp_path):
    stream = progress.in_order(table(spark, events), "ts", 3, str(tmp_path / "in"))
    found = progress.drained(progress.latest(stream, ["cache"], "name", ["ts", "event_id"]), "complete", str(tmp_path / "out"))
    last = {c: max(e for e in events if e[2] == c)[3] for c in "ab"}
    assert {r.cache: r.name for r in found.collect()} == last


def test_single_flight_on_a_stream(spark, tmp_path):
    rows = [(START + timedelta(seconds=s), i, k) for i, (s, k) in enumerate([(0, "a"), (1, "a"), (2, "b"), (3, "a"), (4, "b")])]
    stream = progress.in_order(spark.createDataFrame(rows, "ts timestamp, event_id long, key string"), "ts", 2, str(tmp_path / "in"))
    found = progress.drained(progress.one_flight_each(stream, "key", "ts", "1 minute"), "append", str(tmp_path / "out"))
    assert sorted(r.key for r in found.collect()) == ["a", "b"]
