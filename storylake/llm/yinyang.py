"""Centroid clustering with Yinyang's group bounds, exact on integers.

Centroids are clustered into groups once. Every vector keeps an upper bound of
the distance to its own centroid and, for each group, one lower bound of the
distance to the group's other centroids. When centroids move, bounds move with
them; a vector whose least lower bound stays above its upper bound keeps its
centroid without any distance (global filter), of the others only groups whose
bound doesn't exceed the best distance so far are scanned, exactly (group filter).

Vectors and their bounds are a table written once a round; nothing is shuffled.
Sums of a centroid change by the vectors that moved, which tasks add up before
Spark does. What reaches the driver are centroids: ``k`` times the dimensions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storylake.sources.shared import Rounds

#: Scaled components at or beyond it have squared distances that no long holds.
LARGEST = 2**27
#: Bounds are kept apart from exact values by this part of them, far above the rounding of doubles.
SLACK = 1e-9
STATE = "vec_id {id}, vec array<int>, cluster int, was int, upper double, lower array<double>, distance bigint"


@dataclass(frozen=True)
class Clustering:
    """``members`` has ``vec_id, cluster, distance`` of every kept vector; row i of ``centroids`` is that of cluster i."""

    members: DataFrame
    centroids: np.ndarray


def scaled_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """``vec_id, vec`` of the vectors with ``dims`` components, none null, non-finite or too large; each becomes floor(scale * x)."""
    vec = F.col(f"`{vec_col}`")
    fits = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < LARGEST))
    kept = df.where(vec.isNotNull() & (F.size(vec) == dims) & fits)
    return kept.select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("vec"))


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid; int64 wraps in between and is right in the end."""
    return (vectors * vectors).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * (vectors @ centroids.T)


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """A group for each centroid: a few rounds of nearest means over the ``k`` centroids."""
    points = centroids.astype(np.float64)
    means = points[:: max(1, len(points) // groups)][:groups].copy()
    for _ in range(rounds):
        near = ((points[:, None, :] - means[None, :, :]) ** 2).sum(2).argmin(1)
        for g in np.unique(near):
            means[g] = points[near == g].mean(0)
    return np.unique(near, return_inverse=True)[1]


def reassign(vectors, cluster, upper, lower, centroids, groups, drift) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids (of equal ones the smallest number) after they moved by ``drift``: clusters, bounds, distances taken.

    A skipped group is farther than the own centroid by more than nothing, so no tie is lost.
    """
    cluster, members = cluster.copy(), [np.flatnonzero(groups == g) for g in range(groups.max() + 1)]
    upper = upper + drift[cluster] * (1 + SLACK)
    lower = lower - np.array([drift[m].max() for m in members]) * (1 + SLACK)
    todo = np.flatnonzero(lower.min(1) <= upper)
    difference = vectors[todo] - centroids[cluster[todo]]
    own = (difference * difference).sum(1)
    upper[todo] = np.sqrt(own) * (1 + SLACK)
    taken, open_ = len(todo), lower[todo].min(1) <= upper[todo]
    todo, own = todo[open_], own[open_]
    old, best, best_id = cluster[todo], own.copy(), cluster[todo].copy()
    bounds, runner_up, scanned = lower[todo], np.full((len(todo), len(members)), np.inf), np.zeros((len(todo), len(members)), bool)
    for g, ids in enumerate(members):
        rows = np.flatnonzero(bounds[:, g] <= np.sqrt(best) * (1 + SLACK))
        if not len(rows):
            continue
        found = squared(vectors[todo[rows]], centroids[ids])
        taken += found.size
        at = found.argmin(1)
        least, least_id = found[np.arange(len(rows)), at], ids[at]
        scanned[rows, g] = True
        bounds[rows, g] = np.sqrt(least) * (1 - SLACK)
        if len(ids) > 1:
            runner_up[rows, g] = np.sqrt(np.partition(found, 1, axis=1)[:, 1]) * (1 - SLACK)
        better = (least < best[rows]) | ((least == best[rows]) & (least_id < best_id[rows]))
        best[rows[better]], best_id[rows[better]] = least[better], least_id[better]
    every = np.arange(len(todo))
    into = groups[best_id]
    bounds[every, into] = np.where(scanned[every, into], runner_up[every, into], bounds[every, into])
    left = np.flatnonzero((best_id != old) & ~scanned[every, groups[old]])  # the centroid left behind now counts among its group's others
    bounds[left, groups[old[left]]] = np.minimum(bounds[left, groups[old[left]]], np.sqrt(own[left]) * (1 - SLACK))
    cluster[todo], lower[todo], upper[todo] = best_id, bounds, np.sqrt(best) * (1 + SLACK)
    return cluster, upper, lower, taken


def _matrix(column, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _assigned(state: DataFrame, id_type: str, centroids: np.ndarray, groups: np.ndarray, drift: np.ndarray) -> DataFrame:
    """A new state from the last one, in one pass and without a shuffle."""
    dims, wide = centroids.shape[1], int(groups.max()) + 1

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, was = _matrix(batch.column(1), dims, np.int64), batch.column(2).to_numpy().astype(np.int64)
            cluster, upper, lower, _ = reassign(vectors, np.maximum(was, 0), batch.column(4).to_numpy(), _matrix(batch.column(5), wide, np.float64), centroids, groups, drift)
            difference = vectors - centroids[cluster]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(was) + 1) * wide, wide), pa.int32()), pa.array(lower.ravel()))
            columns = [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), lists, pa.array((difference * difference).sum(1))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vec", "cluster", "was", "upper", "lower", "distance"])

    return state.mapInArrow(run, STATE.format(id=id_type))


def _changes(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much sums and counts of the clusters change: the vectors that moved, added up in the tasks first."""

    def run(batches):
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), dims, np.int64)
            for column, sign in ((1, 1), (2, -1)):
                at = batch.column(column).to_numpy()
                for c in np.unique(at[at >= 0]):
                    sums[c] += sign * vectors[at == c].sum(0)
                    counts[c] += sign * int((at == c).sum())
        whole = np.column_stack([counts, sums])
        there = np.flatnonzero(whole.any(1))
        offsets = pa.array(np.arange(len(there) + 1) * (dims + 1), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(whole[there].ravel()))], names=["cluster", "sums"])

    moved = state.where("cluster <> was").select("vec", "cluster", "was").mapInArrow(run, "cluster int, sums array<bigint>")
    totals = moved.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect()
    whole = np.zeros((k, dims + 1), np.int64)
    for row in totals:
        whole[row["cluster"], row["i"]] = row["x"]
    return whole[:, 1:], whole[:, 0]


def cluster_vectors(
    df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2", id_col: str = "vec_id", vec_col: str = "embedding", per_group: int = 10
) -> Clustering:
    """Cluster the vectors of ``df`` by ``rounds`` rounds of nearest centroids and exact floored means, then assign once more.

    Components become integers, so every machine and every order of rows gives
    the same result. Vectors that are null, have another number of components, a
    null or non-finite one, or one beyond ``LARGEST`` after scaling (its squared
    distances fit no long) are left out. The first centroids are the ``k``
    vectors of least sha256 of ``salt:id``, in that order; a null id comes last,
    repeated ids are ordered by their vectors. Fewer vectors than ``k`` give as
    many centroids; an empty table gives none. Repeated rows count as often as
    they occur. Columns may have any name.
    """
    spark, kept = df.sparkSession, scaled_vectors(df, id_col, vec_col, dims, scale)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(order.alias("h"), "vec").orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).collect()
    if not first:
        return Clustering(kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), np.zeros((0, dims), np.int64))
    centroids = np.array([row["vec"] for row in first], np.int64)
    groups = grouped(centroids, max(1, -(-len(first) // per_group)))
    wide, drift = int(groups.max()) + 1, np.zeros(len(first))
    fresh = (F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), F.lit(float("inf")).alias("upper"), F.array_repeat(F.lit(float("-inf")), wide).alias("lower"))
    state, tables = kept.select("vec_id", "vec", *fresh), Rounds(spark, "yinyang")
    sums, counts = np.zeros_like(centroids), np.zeros(len(first), np.int64)
    for _ in range(rounds):
        state = tables.settled(_assigned(state, id_type, centroids, groups, drift))
        more, number = _changes(state, len(first), dims)
        sums, counts = sums + more, counts + number
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        step = moved - centroids
        centroids, drift = moved, np.sqrt((step * step).sum(1))
    state = tables.settled(_assigned(state, id_type, centroids, groups, drift).select("vec_id", "cluster", "distance"))
    return Clustering(state, centroids)


def cluster_digest(df: DataFrame, **parameters) -> DataFrame:
    """``vec_id, cluster, distance`` with the inertia of the cluster and of all, and a digest of the final centroid.

    Nulls, ties, repeated rows and empty tables as ``cluster_vectors`` says. The
    table of clusters that every row meets has ``k`` rows.
    """
    found = cluster_vectors(df, **parameters)
    inertia = {row["cluster"]: row["s"] for row in found.members.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), d) for c, d in enumerate(digest)]
    table = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.members.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
