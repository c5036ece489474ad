"""k-means in whole numbers, with the threshold algorithm for the nearest centroid.

Vectors are kept as whole numbers, floor(scale * x), so every sum and distance is exact. The centroids stand
in one sorted list for each dimension. From a vector's own value two frontiers walk outwards in every list,
always to the nearer entry; a centroid met for the first time gets its exact distance. No unseen centroid is
nearer than the sum of the squared frontier distances, so a vector is done when that sum strictly exceeds its
best distance (strictly, as an unseen one with a smaller number could tie), or when all are seen.

Tasks walk whole batches of vectors in numpy and ship one row of sums per batch and cluster; the driver
sees k centroids only. Each round reads the staged whole-number vectors again.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are left out,
as are those with a component of ``LARGEST`` or more in size, whose distances would not fit 64 bits; repeated
rows count each time; rows without id take part but start no centroid; with fewer than k kept ids there are
fewer centroids, and with none the result is empty; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

LARGEST = 1 << 16  # with scale 1024 and 64 components a squared distance stays below 2^61
BLOCK = 4096       # vectors walked at once


def whole_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v): the vectors that take part, as arrays of whole numbers."""
    value = F.col(vector).cast("array<double>")
    fine = (F.size(value) == size) & F.forall(value, lambda x: x.isNotNull() & (F.abs(x) < LARGEST))
    return vectors.filter(F.coalesce(fine, F.lit(False))) \
        .select(F.col(vec_id).alias("vec_id"), F.transform(value, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def start_order(vec_id: Column, seed: int = 3) -> Column:
    """Seeded order of ids: lowercase hex of sha256 over ``seed:id``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")).cast("binary"), 256)


def nearest(x: np.ndarray, centroids: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid (ties: smallest number), and steps walked.

    ``lists`` holds, for each dimension, the sorted centroid values and their numbers.
    """
    values, numbers = lists
    k, size = centroids.shape
    far = np.iinfo(np.int64).max
    best, owner = np.full(len(x), far), np.zeros(len(x), np.int64)
    seen = np.zeros((len(x), k), bool)
    # One sentinel at either end of a list: a frontier that stands there is out of entries.
    up = np.stack([np.searchsorted(values[d], x[:, d]) for d in range(size)], 1)
    down = up - 1
    active, dims, steps = np.arange(len(x)), np.arange(size), 0
    for _ in range(k):
        steps += 1
        row = x[active]
        below = np.where(down >= 0, row - values[dims, np.maximum(down, 0)], far)
        above = np.where(up < k, values[dims, np.minimum(up, k - 1)] - row, far)
        lower = below <= above
        frontier = np.where(lower, below, above)
        met = numbers[dims, np.where(lower, np.maximum(down, 0), np.minimum(up, k - 1))]
        down, up = down - lower, up + ~lower
        new = np.zeros((len(active), k), bool)
        new[np.arange(len(active))[:, None], met] = True
        new &= ~seen[active]
        i, c = np.nonzero(new)
        seen[active[i], c] = True
        distance = np.full((len(active), k), far)
        distance[i, c] = ((row[i] - centroids[c]) ** 2).sum(1)
        number = distance.argmin(1)
        distance = distance[np.arange(len(active)), number]
        better = (distance < best[active]) | ((distance == best[active]) & (number < owner[active]))
        best[active[better]], owner[active[better]] = distance[better], number[better]
        open_ = ((frontier ** 2).sum(1) <= best[active]) & ~seen[active].all(1)
        if not open_.any():
            break
        active, down, up = active[open_], down[open_], up[open_]
    return owner, best, steps


def sorted_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and centroid numbers of each dimension."""
    numbers = np.argsort(centroids.T, axis=1, kind="stable")
    return np.take_along_axis(centroids.T, numbers, 1), numbers


def _blocks(batch: pa.RecordBatch, size: int):
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        yield part, part.column("v").flatten().to_numpy().reshape(-1, size)


def _sums(centroids: np.ndarray):
    lists = sorted_lists(centroids)

    def add(batches):
        for batch in batches:
            k, size = centroids.shape
            total, many = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
            for _, x in _blocks(batch, size):
                owner, _, _ = nearest(x, centroids, lists)
                np.add.at(total, owner, x)
                many += np.bincount(owner, minlength=k)
            some = np.flatnonzero(many)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(many[some]),
                                              pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])
    return add


def _assigned(centroids: np.ndarray):
    lists = sorted_lists(centroids)

    def assign(batches):
        for batch in batches:
            for part, x in _blocks(batch, centroids.shape[1]):
                owner, best, _ = nearest(x, centroids, lists)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(owner.astype(np.int32)), pa.array(best)],
                                                 names=["vec_id", "cluster", "distance"])
    return assign


def fit(whole: DataFrame, *, k: int = 8, rounds: int = 10, size: int = 64, seed: int = 3) -> np.ndarray:
    """Centroids after ``rounds`` of assignment and exact floor means; empty clusters keep theirs."""
    first = whole.filter(F.col("vec_id").isNotNull()).orderBy(start_order(F.col("vec_id"), seed), "v").limit(k).select("v").collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, size)
    for _ in range(rounds if len(centroids) else 0):
        sums = whole.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>") \
            .select("cluster", "n", F.posexplode("sums").alias("d", "s")) \
            .groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect()
        centroids = centroids.copy()
        for r in sums:  # k * size rows
            centroids[r.cluster, r.d] = int(r.s) // r.n
    return centroids


def cluster(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10,
            size: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each kept vector."""
    spark = vectors.sparkSession
    whole = stage(whole_vectors(vectors, vec_id=vec_id, vector=vector, size=size, scale=scale))
    id_type = dict(whole.dtypes)["vec_id"]
    centroids = fit(whole, k=k, rounds=rounds, size=size, seed=seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = stage(whole.mapInArrow(_assigned(centroids), f"vec_id {id_type}, cluster int, distance long"))
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    named = spark.createDataFrame(
        [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in inertia],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", *named.columns[:1], "distance", *named.columns[1:])
