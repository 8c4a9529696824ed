"""One-sided Student-t p-values, vectorised over Arrow batches."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _log_beta(a: np.ndarray, b: float) -> np.ndarray:
    log_gamma = np.vectorize(lgamma, otypes=[float])
    return log_gamma(a) + lgamma(b) - log_gamma(a + b)


def _continued_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    value = d.copy()
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + numerator / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            value = value * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return value


def _half_beta(nu: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(nu/2, 1/2), with y = 1 - x given exactly."""
    a, b = nu / 2.0, np.full_like(nu, 0.5)
    with np.errstate(divide="ignore", under="ignore"):
        front = np.exp(a * np.log(x) + 0.5 * np.log(y) - _log_beta(a, 0.5))
    direct = x < (a + 1.0) / (a + b + 2.0)
    lower = front * _continued_fraction(a, b, np.where(direct, x, 0.0)) / a
    upper = 1.0 - front * _continued_fraction(b, a, np.where(direct, 0.0, y)) / b
    return np.where(direct, lower, upper)


def upper_tail(t: np.ndarray, nu: np.ndarray) -> np.ndarray:
    """P(T > t) for ``nu`` degrees of freedom."""
    t, nu = np.asarray(t, dtype=float), np.asarray(nu, dtype=float)
    square = t * t
    tail = 0.5 * _half_beta(nu, nu / (nu + square), square / (nu + square))
    return np.where(t > 0, tail, np.where(t < 0, 1.0 - tail, 0.5))


def _p_values(t: pd.Series, n: pd.Series) -> pd.Series:
    result = np.ones(len(t))
    t, n = t.to_numpy(dtype=float, na_value=np.nan), n.to_numpy(dtype=float)
    known = np.isfinite(t) & (n > 1)
    if known.any():
        result[known] = upper_tail(t[known], n[known] - 1)
    return pd.Series(result)


def positive_mean_p_value(t_stat: Column, sample_count: Column) -> Column:
    """p-value of H1: mean > 0; 1 where no t statistic exists."""
    return F.pandas_udf(_p_values, "double")(t_stat, sample_count.cast("long"))
