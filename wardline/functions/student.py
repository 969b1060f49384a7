"""Tail probabilities of Student's t in numpy: the regularised incomplete beta function by its continued fraction."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 300):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + up / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    return h


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """2 * P(T > |t|) with ``df`` degrees of freedom; NaN where t is NaN, 0 where it is infinite."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    x = np.where(np.isinf(t), 0.0, df / (df + np.square(np.where(np.isfinite(t), t, 0.0))))
    a, b = df / 2, 0.5
    log_beta = np.array([math.lgamma(y) + math.lgamma(b) - math.lgamma(y + b) for y in a])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-np.minimum(x, 1 - 1e-16)) - log_beta)
        direct = x < (a + 1) / (a + b + 2)
        left = front * _beta_fraction(a, b, np.where(direct, x, 0.5)) / a
        swapped = 1 - front * _swapped(a, b, np.where(direct, 0.5, 1 - x)) / b
    p = np.where(direct, left, swapped)
    return np.where(np.isnan(t), np.nan, np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.clip(p, 0, 1))))


def _swapped(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    return _beta_fraction(np.full_like(x, b), a, x)
