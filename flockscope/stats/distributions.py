"""Tail probabilities that Spark has no function for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands in for 0 in denominators of the continued fraction.
TINY = 1e-300


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for positive values: Stirling's series from 10 on, reached by the recurrence."""
    x = np.array(x, dtype=np.float64)
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    inv = 1.0 / (x * x)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv * (1 / 1680 - inv / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray, terms: int = 500) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b), element by element.

    By its continued fraction, on the side of the mean where that converges
    fast, evaluated from the far end inwards in a fixed number of terms.
    """
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=np.float64) for v in (x, a, b)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tail = np.ones_like(z)
    for m in range(terms, 0, -1):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        inner = 1 + odd / np.where(np.abs(tail) < TINY, TINY, tail)
        tail = 1 + even / np.where(np.abs(inner) < TINY, TINY, inner)
    first = 1 - (p + q) * z / (p + 1) / np.where(np.abs(tail) < TINY, TINY, tail)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    part = np.where(z <= 0, 0.0, front / first)
    return np.clip(np.where(swap, 1 - part, part), 0.0, 1.0)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic; null without a statistic or a positive number of degrees of freedom."""
    @F.pandas_udf("double")
    def tail(stat: pd.Series, free: pd.Series) -> pd.Series:
        s, n = stat.to_numpy(np.float64), free.to_numpy(np.float64)
        known = ~np.isnan(s) & (n > 0)
        n1, s2 = np.where(known, n, 1.0), np.where(known, s, 0.0) ** 2
        with np.errstate(invalid="ignore", over="ignore"):
            share = np.where(np.isinf(s2), 0.0, n1 / (n1 + np.where(np.isinf(s2), 0.0, s2)))
        p = incomplete_beta(share, n1 / 2, np.full_like(n1, 0.5))
        return pd.Series([float(v) if k else None for v, k in zip(p, known, strict=True)], dtype="object")
    return tail(t.cast("double"), df.cast("double"))
