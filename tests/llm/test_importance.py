"""Importance resampling against a plain version, and its edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from storylake.llm import importance


def features(text, buckets=10_000):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(importance.LOWERED))
    return Counter(zlib.crc32(g.encode()) % buckets for g in words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def plain(docs, target):
    per = [(i, features(t)) for i, t in docs]
    source, wanted = sum((c for _, c in per), Counter()), sum((features(t) for t in target), Counter())
    s_all, t_all = source.total(), wanted.total()
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000))))
    rows = []
    for i, c in per:
        weight = sum(gain(b) * n for b, n in c.items()) // c.total() if c else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in rows if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for n, row in enumerate(order[: 25 * len(order) // 100], 1):
        row[4] = n
    return sorted(map(str, rows))


def test_equals_a_plain_version(spark):
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choices(["Straße", "the", "Cat", "sat", "名", "x1", "ÄB"] + [f"w{i}" for i in range(90)], k=n))
    docs = [(i, text(rnd.choice([1, 19, 20, 60]))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " .,"), (303, "word " * 30), (None, text(50)), (5, text(40)), (5, text(40)), (7, docs[7][1]), (7, docs[7][1]), (304, "z" * 300_000)]
    target = [(i, text(12)) for i in range(9)] + [(9, None)]
    frame = spark.createDataFrame([(i, t, t) for i, t in docs], "doc_id long, text string, rank string").repartition(6)
    found = importance.resample(frame, spark.createDataFrame(target, "item_id long, text string"))
    assert sorted(str(list(r)) for r in found.collect()) == plain(docs, [t for _, t in target])
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_pieces_of_a_long_text_count_like_the_whole():
    rnd = random.Random(4)
    text = "".join(rnd.choices(["Ab", "é", " ", ".", "longerword" * 5, "名名 "], k=3_000))
    count = importance.Counter(10_000)
    for size in (7, 64, 1_000, 1 << 21):
        ((buckets, n),) = importance.counted(count, [text], 10_000, size)
        assert dict(zip(buckets.tolist(), n.tolist())) == dict(features(text))


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs, target).collect() == []
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert importance.resample(some, target).first()["n_features"] == 79
