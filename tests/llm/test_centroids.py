"""Threshold algorithm and exact k-means against plain loops."""

import hashlib
import math

import numpy as np

from barloom.llm import centroids as c


def test_nearest_equals_all_distances_with_ties():
    rng = np.random.default_rng(8)
    for k, size, spread in ((1, 3, 10), (8, 64, 900), (40, 2, 5), (25, 6, 3), (9, 4, 1)):
        points, x = rng.integers(-spread, spread + 1, (k, size)), rng.integers(-spread, spread + 1, (500, size))
        owner, best, _ = c.nearest(x, points, c.sorted_lists(points))
        every = ((x[:, None, :] - points[None]) ** 2).sum(2)
        assert (owner == every.argmin(1)).all() and (best == every.min(1)).all()


def test_near_vectors_stop_early():
    points = np.arange(50)[:, None] * np.full(8, 1000)
    _, _, steps = c.nearest(points + 1, points, c.sorted_lists(points))
    assert steps <= 3


def plain(rows, k, rounds, size):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) < c.LARGEST for x in v)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in order[:k]]
    if not points:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), n) for n, p in enumerate(points))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        points = [[sum(d) // len(groups[n]) for d in zip(*groups[n])] if n in groups else p for n, p in enumerate(points)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    return sorted(((i is not None, i or 0, n, d, sum(e for _, m, e in found if m == n), sum(e for *_, e in found),
                    hashlib.sha256(",".join(map(str, points[n])).encode()).hexdigest()) for i, n, d in found))


def clustered(spark, rows, **how):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string")
    got = c.cluster(table, **how).collect()
    return sorted((r.vec_id is not None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


def test_clusters_equal_plain_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(120)]
    rows += [(5, rows[5][1]), (200, None), (201, [1.0] * 3), (202, [1.0, None, 0.0, 0.0]), (203, [math.nan] * 4), (204, [math.inf] * 4),
             (None, [0.5] * 4), (205, [1e9] * 4), *((300 + i, [0.0] * 4) for i in range(60))]
    assert clustered(spark, rows, size=4) == plain(rows, 8, 10, 4)
    same = [(i, [0.25] * 4) for i in range(20)]  # equal vectors: all but one cluster stay empty
    assert clustered(spark, same, size=4) == plain(same, 8, 10, 4)


def test_few_or_no_vectors(spark):
    few = [(1, [0.1, 0.2]), (2, [5.0, 5.0])]
    assert clustered(spark, few, size=2) == plain(few, 8, 10, 2)
    assert clustered(spark, [(1, None), (None, [0.1, 0.2])], size=2) == []
    assert clustered(spark, [], size=2) == []
