"""Centroid clustering in whole numbers; nearest centroids are found by the threshold algorithm.

The centroids stand in one sorted list per dimension. A vector walks every list outward from its own value, one step a round: in
each dimension the nearer of the two frontier entries is next. A centroid met in any list gets its exact distance. No centroid
that was not met yet is nearer than the sum of the squared frontier gaps, so a vector is done once that sum strictly exceeds its
best distance; at equality it walks on, because a smaller number may still tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.frames import stored

_TOGETHER = 1024  # vectors that walk side by side
_SAFE = 1 << 26  # components up to here leave squared distances of thousands of dimensions within 64 bits
_LIMB = 1 << 60


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles; Python integers where 64 bits are too few."""
    if not vectors.size or np.abs(vectors).max() < _SAFE / scale:
        return np.floor(vectors * scale).astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2.0**53 else floor(x * scale) for x in vectors.reshape(-1).tolist()]
    return np.array(exact, object).reshape(vectors.shape)


def _walk(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, dims = vectors.shape
    k = len(centroids)
    far = 2 * max(abs(int(vectors.min())), abs(int(vectors.max())), abs(int(centroids.min())), abs(int(centroids.max()))) + 1  # beyond any gap
    high = np.stack([np.searchsorted(lists[:, d], vectors[:, d]) for d in range(dims)], 1)
    low = high - 1
    dim = np.arange(dims)
    met = np.zeros((n, k), bool)
    best = np.full(n, dims * far * far + 1, vectors.dtype)
    nearest = np.full(n, k)
    active = np.arange(n)
    for _ in range(k):
        x, lo, hi = vectors[active], low[active], high[active]
        below = np.where(lo >= 0, x - lists[np.maximum(lo, 0), dim], far)
        above = np.where(hi < k, lists[np.minimum(hi, k - 1), dim] - x, far)
        down = below <= above
        entry = order[np.where(down, np.maximum(lo, 0), np.minimum(hi, k - 1)), dim]
        gap = np.where(down, below, above)
        low[active], high[active] = lo - down, hi + ~down
        seen = np.zeros((len(active), k), bool)
        seen[np.arange(len(active))[:, None], entry] = True
        fresh = seen & ~met[active]
        met[active] |= seen
        row, number = np.nonzero(fresh)
        apart = x[row] - centroids[number]
        distance = np.full(fresh.shape, best.max() + 1, vectors.dtype)
        distance[row, number] = (apart * apart).sum(1)
        found = distance.argmin(1)  # the smallest number among equals
        value = distance[np.arange(len(active)), found]
        known, holder = best[active], nearest[active]
        better = (value < known) | ((value == known) & (found < holder))
        best[active], nearest[active] = np.where(better, value, known), np.where(better, found, holder)
        active = active[(gap * gap).sum(1) <= best[active]]
        if not len(active):
            break
    return nearest, best


def assign(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of every row, ties to the smaller, and the squared distance."""
    if vectors.dtype == object or centroids.dtype == object or np.abs(centroids).max() > _SAFE:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    order = np.argsort(centroids, axis=0, kind="stable")
    lists = np.take_along_axis(centroids, order, 0)
    parts = [_walk(vectors[i:i + _TOGETHER], centroids, order, lists) for i in range(0, len(vectors), _TOGETHER)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _batch(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    return whole(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), scale)


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    sign, total, place = (-1 if total < 0 else 1), abs(total), 0
    while total or not place:
        total, rest = divmod(total, _LIMB)
        yield place, sign * rest
        place += 1


def _sums(centroids: np.ndarray, scale: int):
    """Per task and cluster: how many vectors, and the sum of every component as numbers of 60 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        totals, n = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 14):
                v = _batch(batch.slice(i, 1 << 14), scale)
                cluster, _ = assign(v, centroids)
                n += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster).tolist():
                    totals[c] += v[cluster == c].sum(0)
        rows = [(c, d, place, int(n[c]), value) for c in np.flatnonzero(n).tolist() for d in range(dims) for place, value in _limbs(int(totals[c, d]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["cluster", "dim", "place", "n", "total"])

    return run


def _assigned(centroids: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = assign(_batch(batch, scale), centroids)
                fits = pa.array([x if x < 1 << 63 else None for x in distance.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), fits], names=["vec_id", "cluster", "distance"])

    return run


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def centroid_clusters(vectors: DataFrame, *, dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of vectors(vec_id, embedding).

    Rows whose embedding is null, has another number of components than `dims`, or a null or non-finite one, are left out. The first
    centroids are the `k` kept rows with the smallest sha256 of `<seed>:<vec_id>`, all of them where there are fewer; repeated ids by
    their components, null ids last. Repeated rows count and are returned each; other columns are ignored; an empty table gives no rows.
    Sums are exact at any size; a distance, and a sum that holds it, is null where 64 bits are too few.
    Only the k centroids and their sums reach the driver; every round is one pass over the stored vectors.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = stored(rows.filter((F.size("v") == dims) & finite), "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select(drawn.alias("draw"), "v").orderBy(F.asc_nulls_last("draw"), "v").limit(k).collect()
    out = "vec_id long, cluster int, distance long"
    if not first:
        return rows.sparkSession.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = whole(np.array([r.v for r in first]), scale)
    for _ in range(rounds):
        parts = rows.mapInArrow(_sums(centroids, scale), "cluster long, dim long, place long, n long, total long")
        sums = parts.groupBy("cluster", "dim", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        size, total = {}, {}
        for r in sums.collect():  # at most k * dims numbers, in limbs
            at = (r.cluster, r.dim)
            total[at] = total.get(at, 0) + int(r.total) * _LIMB**r.place
            if r.place == 0:
                size[at] = r.n
        moved = centroids.astype(object)
        for (c, d), value in total.items():
            moved[c, d] = value // size[c, d]
        small = max(abs(int(x)) for x in moved.reshape(-1)) <= _SAFE
        centroids = moved.astype(np.int64) if small else moved
    found = stored(rows.mapInArrow(_assigned(centroids, scale), out), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    summed = F.when(F.count("distance") == F.count("*"), exact)
    each = found.groupBy("cluster").agg(summed.alias("part")).collect()  # at most k rows
    parts = [r.part for r in each]
    whole_sum = None if any(p is None for p in parts) else sum(parts)
    fit = lambda x: None if x is None or x >= 1 << 63 else int(x)
    known = rows.sparkSession.createDataFrame([(r.cluster, fit(r.part), fit(whole_sum), _digest(centroids[r.cluster])) for r in each],
                                              "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
