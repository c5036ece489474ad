"""Linear models from moments: Gram matrices of row segments, and elastic-net paths over them.

The rows are read twice whatever the number of folds and penalties: once for the scales of every
training part, once for one Gram matrix for each segment between fold borders. A training or validation part is a
sum of segments; fits and errors are then work on matrices of the size of the feature set.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segment_moments(rows: DataFrame, columns: Sequence[str], borders: Sequence[int], shift: Sequence[float],
                    place: str = "_i") -> np.ndarray:
    """Gram matrices of (1, columns less shift) for the rows of each segment [border, next border) of ``place``.

    Tasks add up their rows by matrix products; their partial sums, one row for each matrix entry and segment, are
    added by Spark. Rows before the first and from the last border on do not count.
    """
    edges, off, k = np.array(borders), np.array([0.0, *shift]), len(columns) + 1

    def add(batches):
        total = np.zeros((len(edges) - 1, k, k))
        for batch in batches:
            at = np.searchsorted(edges, batch.column(0).to_numpy(), side="right") - 1
            z = np.column_stack([np.ones(batch.num_rows), *(batch.column(c).to_numpy(zero_copy_only=False) for c in columns)]) - off
            for s in np.unique(at[(at >= 0) & (at < len(total))]):
                part = z[at == s]
                total[s] += part.T @ part
        segment, entry = np.nonzero(total.reshape(len(total), -1))
        yield pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), pa.array(entry, pa.int32()),
                                          pa.array(total.reshape(len(total), -1)[segment, entry])], names=["segment", "entry", "value"])

    numbers = rows.select(F.col(place).cast("long").alias(place), *[F.col(c).cast("double").alias(c) for c in columns])
    sums = numbers.mapInArrow(add, "segment int, entry int, value double").groupBy("segment", "entry").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((len(edges) - 1, k * k))
    out[sums["segment"].to_numpy(), sums["entry"].to_numpy()] = sums["value"].to_numpy()
    return out.reshape(-1, k, k)


def part_scales(rows: DataFrame, features: Sequence[str], ends: Iterable[int], place: str = "_i") -> dict[int, np.ndarray]:
    """Median and interquartile range (1 where it is 0) of each feature over the rows before each end, in one pass."""
    ends = list(ends)
    found = rows.agg(*[F.percentile_approx(F.when(F.col(place) < end, F.col(f)), [0.25, 0.5, 0.75], 10_000).alias(f"{e} {j}")
                       for e, end in enumerate(ends) for j, f in enumerate(features)]).first()
    out = {}
    for e, end in enumerate(ends):
        q = np.array([found[f"{e} {j}"] or [0.0, 0.0, 1.0] for j in range(len(features))], float).T
        out[end] = np.vstack((q[1], np.where(q[2] > q[0], q[2] - q[0], 1.0)))
    return out


def centred(gram: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(Q, c, means, mean of y, variance of y) per row of scaled features, from the Gram matrix of (1, x, y)."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    return cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale, mean[:-1], float(mean[-1]), float(cov[-1, -1])


def descend(q: np.ndarray, c: np.ndarray, alpha: float, l1_share: float, start: np.ndarray, sweeps: int = 2000,
            tolerance: float = 1e-10) -> np.ndarray:
    """Minimum of b'Qb/2 - c'b + alpha (share |b|_1 + (1 - share)/2 b'b), by coordinates from ``start``."""
    b, l1, l2 = start.copy(), alpha * l1_share, alpha * (1 - l1_share)
    rest = c - q @ b
    for _ in range(sweeps):
        largest = 0.0
        for j in np.flatnonzero(np.diag(q) > 0):
            free = rest[j] + q[j, j] * b[j]
            new = np.sign(free) * max(abs(free) - l1, 0.0) / (q[j, j] + l2)
            if new != b[j]:
                rest -= q[:, j] * (new - b[j])
                largest, b[j] = max(largest, abs(new - b[j]) * np.sqrt(q[j, j])), new
        if largest < tolerance:
            break
    return b


def solve(q: np.ndarray, c: np.ndarray, alpha: float, l1_share: float, start: np.ndarray) -> np.ndarray:
    """``descend``, or the normal equations where nothing is penalised."""
    return np.linalg.lstsq(q, c, rcond=None)[0] if alpha == 0 else descend(q, c, alpha, l1_share, start)


def error(gram: np.ndarray, coefficients: np.ndarray, intercept: float) -> float:
    """Mean squared error of raw-scale coefficients over the rows of a Gram matrix of (1, x, y)."""
    w = np.array([-intercept, *-coefficients, 1.0])
    return float(w @ gram @ w / gram[0, 0])


class ElasticPath:
    """Fits of all penalties on all folds, held as raw-scale coefficients of features less ``shift``."""

    def __init__(self, rows: DataFrame, features: Sequence[str], target: str, folds: Sequence[tuple[int, int, int]],
                 l1_shares: Sequence[float], alphas: Sequence[float]):
        self.features, self.target, self.folds = list(features), target, list(folds)
        scales = part_scales(rows, features, [end for end, _, _ in folds])
        self.shift = np.append(scales[max(scales)][0], 0.0)  # near the means, so that sums of squares stay small
        borders = sorted({0, *(x for fold in folds for x in fold)})
        grams = segment_moments(rows, [*features, target], borders, self.shift)

        def part(lo, hi):
            return sum(g for g, a in zip(grams, borders) if lo <= a < hi)

        self.fits: dict[tuple[float, float, int], tuple[np.ndarray, float]] = {}
        self.errors: dict[tuple[float, float], float] = {}
        found: dict[tuple[float, float], list[float]] = {}
        for f, (end, lo, hi) in enumerate(folds):
            scale, held_out = scales[end][1], part(lo, hi)
            q, c, mean, y, _ = centred(part(0, end), scale)
            for share in l1_shares:
                b = np.zeros(len(c))
                for alpha in sorted(alphas, reverse=True):  # each start is the fit before it
                    b = solve(q, c, alpha, share, b)
                    raw = b / scale
                    fit = raw, y - float(raw @ mean)
                    self.fits[share, alpha, f] = fit
                    found.setdefault((share, alpha), []).append(error(held_out, *fit))
        self.errors = {point: sum(e) / len(e) for point, e in found.items()}

    def best(self) -> tuple[float, float]:
        """(l1 share, alpha) with the smallest mean error; of equal ones the first in the grid."""
        return min(self.errors, key=self.errors.get)

    def held_out(self, rows: DataFrame, point: tuple[float, float], place: str = "_i") -> DataFrame:
        """(fold, pred, target) of all validation rows at one point, in one pass."""
        options = []
        for f, (_, lo, hi) in enumerate(self.folds):
            options.append(F.when(F.col(place).between(lo, hi - 1), F.struct(F.lit(f).alias("fold"), self.value(*self.fits[*point, f]).alias("pred"))))
        scored = rows.select(self.target, F.explode(F.array_compact(F.array(*options))).alias("_s"))
        return scored.select("_s.fold", "_s.pred", self.target)

    def value(self, coefficients: np.ndarray, intercept: float) -> Column:
        out = F.lit(intercept)
        for f, b, s in zip(self.features, coefficients.tolist(), self.shift.tolist()):
            if b:
                out = out + F.lit(b) * (F.col(f) - F.lit(s))
        return out
