"""Centroid clustering against a plain version, and its edge cases."""

import hashlib
import math
import random

import numpy as np

from storylake.llm import yinyang


def plain(rows, k=40, rounds=5, dims=64):
    """Every distance of every vector, in Python's integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        parts = [[] for _ in centroids]
        for _, v in kept:
            parts[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(p) for x in zip(*p)] if p else c for p, c in zip(parts, centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(r[2] for r in found)
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, d, sum(r[2] for r in found if r[1] == c), total, sha(c)) for i, c, d in found), key=str)


def test_equals_every_distance(spark):
    rnd = random.Random(5)
    middles = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(7)]
    rows = [(i, [rnd.gauss(m, 0.3) for m in middles[i % 7]]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)]  # copies
    rows += [(None, rows[5][1]), (3, rows[9][1]), (3, rows[3][1]), (500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 63 + [None]), (504, [1.0] * 63 + [float("nan")]), (505, [float("inf")] + [0.0] * 63)]
    rows += [(600 + i, [float(i % 2)] * 64) for i in range(40)]  # ties
    named = [(i, v, i) for i, v in rows]
    df = spark.createDataFrame(named, "vec_id long, `embed ding` array<double>, cluster long").repartition(5)
    found = yinyang.cluster_digest(df, vec_col="embed ding")
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], "vec_id long, embedding array<float>")
    found = sorted(map(tuple, yinyang.cluster_digest(df).collect()))
    assert [r[2] for r in found] == [0, 0] and {r[1] for r in found} == {0, 1}
    assert yinyang.cluster_digest(df.where("false")).collect() == []


def test_filters_save_distances():
    """Bounds give the same clusters as every distance would, with a fraction of them."""
    rng = np.random.default_rng(1)
    middles = rng.integers(-3000, 3000, (40, 64))
    vectors = middles[rng.integers(0, 40, 4000)] + rng.integers(-200, 200, (4000, 64))
    centroids, groups = vectors[:40].copy(), yinyang.grouped(vectors[:40], 4)
    wide, taken = groups.max() + 1, []
    cluster, upper, lower, drift = np.zeros(4000, np.int64), np.full(4000, np.inf), np.full((4000, wide), -np.inf), np.zeros(40)
    for _ in range(8):
        cluster, upper, lower, n = yinyang.reassign(vectors, cluster, upper, lower, centroids, groups, drift)
        assert (cluster == yinyang.squared(vectors, centroids).argmin(1)).all()
        taken.append(n)
        new = np.array([vectors[cluster == c].sum(0) // max(1, (cluster == c).sum()) if (cluster == c).any() else centroids[c] for c in range(40)])
        drift, centroids = np.sqrt(((new - centroids) ** 2).sum(1)), new
    assert taken[0] >= 160_000 and taken[-1] < 0.2 * taken[0]
