"""Prefix compositions of simple maps, vectorised: no Python step per row.

A sequence of n maps is cut into about sqrt(n) stretches. One array step advances all
stretches by one row, which composes the maps of each; the stretches' ends are
chained, and every row's composed map is applied to the value its stretch is entered
with.
"""

from __future__ import annotations

import math

import numpy as np


def _stretches(x: np.ndarray, fill: float) -> np.ndarray:
    """Rows of a stretch below each other, one column a stretch; filled up at the end."""
    length = math.isqrt(max(len(x) - 1, 0)) + 1
    count = -(-len(x) // length)
    padded = np.full(length * count, fill)
    padded[: len(x)] = x
    return np.ascontiguousarray(padded.reshape(count, length).T)


def affine_scan(scale: np.ndarray, shift: np.ndarray, start: float) -> np.ndarray:
    """y[t] = scale[t] * y[t-1] + shift[t], entered with ``start``."""
    if not len(scale):
        return np.empty(0)
    a, b = _stretches(scale, 1.0), _stretches(shift, 0.0)
    for t in range(1, len(a)):
        b[t] += a[t] * b[t - 1]
        a[t] *= a[t - 1]
    entry, value = [], float(start)
    for by, plus in zip(a[-1].tolist(), b[-1].tolist(), strict=True):
        entry.append(value)
        value = by * value + plus
    return (b + a * np.array(entry)).T.ravel()[: len(scale)]


def clamp_scan(low: np.ndarray, high: np.ndarray, start: float) -> np.ndarray:
    """y[t] = min(high[t], max(low[t], y[t-1])), entered with ``start``; comparisons only, so exact."""
    if not len(low):
        return np.empty(0)
    lows, highs = _stretches(low, -np.inf), _stretches(high, np.inf)
    floor, ceiling = np.empty_like(lows), np.empty_like(highs)
    floor[0], ceiling[0] = np.minimum(highs[0], lows[0]), highs[0]
    for t in range(1, len(floor)):
        floor[t] = np.minimum(highs[t], np.maximum(lows[t], floor[t - 1]))
        ceiling[t] = np.minimum(highs[t], np.maximum(lows[t], ceiling[t - 1]))
    entry, value = [], float(start)
    for least, most in zip(floor[-1].tolist(), ceiling[-1].tolist(), strict=True):
        entry.append(value)
        value = min(most, max(least, value))
    return np.minimum(ceiling, np.maximum(floor, np.array(entry))).T.ravel()[: len(low)]


def last_nonzero(x: np.ndarray, start: float) -> np.ndarray:
    """The latest value other than 0 up to each row; ``start`` before the first."""
    at = np.where(x != 0, np.arange(len(x)), -1)
    at = np.maximum.accumulate(at) if len(x) else at
    return np.where(at >= 0, x[np.maximum(at, 0)], start) if len(x) else np.empty(0)
