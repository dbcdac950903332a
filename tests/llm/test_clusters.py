import hashlib

import numpy as np

from talkloom.llm.clusters import assign, centroid_clusters


def brute(vectors, centroids):
    distance = ((vectors[:, None].astype(object) - centroids[None].astype(object)) ** 2).sum(2)
    return distance.argmin(1), distance.min(1)


def test_the_walk_finds_the_nearest_with_ties_to_the_smaller_number():
    rnd = np.random.default_rng(3)
    for dims, k, spread in ((1, 5, 3), (2, 9, 4), (3, 40, 2), (8, 12, 50), (64, 40, 90), (64, 40, 1)):
        vectors, centroids = rnd.integers(-spread, spread + 1, (300, dims)), rnd.integers(-spread, spread + 1, (k, dims))
        centroids[k // 2] = centroids[1]
        vectors[:20] = centroids[rnd.integers(0, k, 20)]
        cluster, distance = assign(vectors, centroids)
        want = brute(vectors, centroids)
        assert (cluster == want[0]).all() and (distance == want[1]).all()
    huge = np.array([[10**40, -5], [3, 4], [-(10**40), 0]], object)
    cluster, distance = assign(huge, np.array([[0, 0], [10**40, 0], [3, 4]], object))
    assert cluster.tolist() == [1, 2, 0] and distance.tolist()[:2] == [25, 0]


def reference(rows, dims, k, rounds):
    kept = [(i, np.array([int(np.floor(256 * float(x))) for x in v], object)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    centroids = [v.copy() for _, v in order[:k]]
    near = lambda v: min((sum((v - c) ** 2), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, members in groups.items():
            centroids[j] = sum(members) // len(members)
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in out if c == j) for j in {c for _, c, _ in out}}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in out)


def test_rounds_equal_a_plain_loop(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, (rnd.normal(0, 0.05, 4) + i % 6).tolist()) for i in range(200)]
    rows += [(7, [1.0, 1.0, 1.0, 1.0])] * 3 + [(8, None), (9, []), (10, [1.0, 2.0, 3.0]), (11, [1.0, None, 3.0, 4.0]), (12, [1.0, float("nan"), 0.0, 0.0]),
                                               (13, [1.0, float("inf"), 0.0, 0.0]), (None, [0.5, 0.25, -0.001, 0.0]), (None, [0.5, 0.25, -0.001, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string, v int")
    for k in (1, 5, 500):
        got = centroid_clusters(frame.repartition(5), dims=4, k=k).collect()
        assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == reference(rows, 4, k, 5)


def test_empty_and_huge(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroid_clusters(spark.createDataFrame([], schema)).count() == 0
    big = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1e30, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in centroid_clusters(big, dims=2, k=1).collect()}
    assert len(got) == 3 and got[1].distance is None and got[1].inertia is None
    got = {r.vec_id: r for r in centroid_clusters(big, dims=2, k=3).collect()}
    assert [got[i].distance for i in (1, 2, 3)] == [0, 0, 0] and got[1].cluster == got[2].cluster
