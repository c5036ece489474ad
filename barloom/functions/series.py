"""Series kernels with no column expression: moving rank, spectrum, range statistic, fractional difference.

They run inside tasks on one chunk of one series at a time (Spark does the partitioning), on
plain arrays.
"""

from __future__ import annotations

import numpy as np


def fractional_weights(d: float, threshold: float) -> np.ndarray:
    """Binomial weights of (1 - B)^d, newest first, cut where they fall below ``threshold``.

    Weights are running products of 1 - (d + 1) / k; beyond d + 1 terms their size only falls.
    """
    size = 64
    while True:
        k = np.arange(1, size)
        weights = np.concatenate(([1.0], np.cumprod(1.0 - (d + 1.0) / k)))
        small = np.flatnonzero(np.abs(weights) < threshold)
        if len(small):
            return weights[:small[0]]
        size *= 4


def fractional_difference(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sum of the last ``len(weights)`` values; NaN where any of them is missing."""
    out = np.full(len(x), np.nan)
    width = len(weights)
    if len(x) < width:
        return out
    missing = np.isnan(x)
    sums = np.convolve(np.where(missing, 0.0, x), weights, mode="valid")
    gaps = np.convolve(missing.astype(float), np.ones(width), mode="valid")
    out[width - 1:] = np.where(gaps < 0.5, sums, np.nan)
    return out


def moving_rank(x: np.ndarray, window: int, min_rows: int) -> np.ndarray:
    """Average rank of each value among the present ones of its window, as a share of their number.

    All windows descend a wavelet matrix over the value codes together: one step for each bit of a
    code, whatever the window's length.
    """
    out = np.full(len(x), np.nan)
    if not len(x):
        return out
    values, codes = np.unique(x, return_inverse=True)  # NaN comes last, above every value
    high = np.arange(1, len(x) + 1)
    low = np.maximum(high - window, 0)
    left, right, row = low, high, codes
    below = np.zeros(len(x), np.int64)
    for bit in range((len(values) - 1).bit_length() - 1, -1, -1):
        ones = (row >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~ones)))
        left_zeros, right_zeros = zeros[left], zeros[right]
        up = (codes >> bit & 1).astype(bool)
        below += np.where(up, right_zeros - left_zeros, 0)
        left = np.where(up, zeros[-1] + left - left_zeros, left_zeros)
        right = np.where(up, zeros[-1] + right - right_zeros, right_zeros)
        row = np.concatenate((row[~ones], row[ones]))
    valid = ~np.isnan(x)
    seen = np.concatenate(([0], np.cumsum(valid)))
    present = seen[high] - seen[low]
    ok = valid & (present >= min_rows)
    out[ok] = (below[ok] + (right[ok] - left[ok] + 1) / 2) / present[ok]
    return out


def _windows_before(x: np.ndarray, window: int, rows: int = 4096):
    """Blocks of the windows [i - window, i) for i >= window."""
    view = np.lib.stride_tricks.sliding_window_view(x, window)[:-1]
    for start in range(0, len(view), rows):
        yield start + window, view[start:start + rows]


def rescaled_range(x: np.ndarray, window: int) -> np.ndarray:
    """Range of the mean-adjusted running sum over the deviation, on the bars before each bar."""
    out = np.full(len(x), np.nan)
    if len(x) <= window:
        return out
    for at, seg in _windows_before(x, window):
        walk = np.cumsum(seg - seg.mean(axis=1, keepdims=True), axis=1)
        spread = seg.std(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(spread > 0, np.ptp(walk, axis=1) / spread, np.nan)
        out[at:at + len(seg)] = value
    return out


def spectral_peak(x: np.ndarray, window: int) -> np.ndarray:
    """Largest over mean magnitude of the return spectrum (without its constant term)."""
    out = np.full(len(x), np.nan)
    if len(x) <= window or window < 4:
        return out
    with np.errstate(invalid="ignore"):
        logs = np.log(x + 1e-10)
    for at, seg in _windows_before(logs, window):
        size = np.abs(np.fft.rfft(np.diff(seg, axis=1), axis=1))[:, 1:]
        out[at:at + len(seg)] = size.max(axis=1) / (size.mean(axis=1) + 1e-10)
    return out
