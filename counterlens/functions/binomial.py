"""Binomial tails, limits and quantiles in numpy, a whole column at a time and for any n.

The mass of one outcome comes from Loader's saddle-point form, in which no large
logarithms cancel; tails are the regularised incomplete beta function, by its continued
fraction on the side where it converges fast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOG_FACTORIAL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1.0, 17.0)))))
_HALF_LOG_2PI = 0.5 * np.log(2 * np.pi)


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """ln n! less Stirling's approximation of it."""
    small = np.clip(n, 1, 16).astype(int)
    exact = _LOG_FACTORIAL[small] - (small + 0.5) * np.log(small) + small - _HALF_LOG_2PI
    x = np.maximum(n, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / x**2) / x**2) / x**2) / x
    return np.where(n <= 16, exact, series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x ln(x / mean) + mean - x, without cancellation where the two are close."""
    v = (x - mean) / (x + mean)
    term, total = 2 * x * v, (x - mean) * v
    for j in range(3, 41, 2):
        term = term * v * v
        total = total + term / j
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / mean), 0) + mean - x
    return np.where(np.abs(v) < 0.1, total, plain)


def mass(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X = k) of n trials, 0 < p < 1."""
    inner = (k > 0) & (k < n)
    kk, nn = np.where(inner, k, 1.0), np.where(inner, n, 2.0)
    log = _stirling_error(nn) - _stirling_error(kk) - _stirling_error(nn - kk) - _deviance(kk, nn * p) - _deviance(nn - kk, nn * (1 - p))
    edge = np.where(k <= 0, n * np.log1p(-p), n * np.log(p))
    return np.where(inner, np.exp(log) / np.sqrt(2 * np.pi * kk * (nn - kk) / nn), np.exp(edge))


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / (1 - (a + b) * x / (a + 1))
    out, live = d.copy(), np.ones(len(x), bool)
    for m in range(1, 100 + int(10 * np.sqrt(np.max(a + b, initial=1)))):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(d == 0, tiny, d)
            c = 1 + num / c
            c = np.where(c == 0, tiny, c)
            out = np.where(live, out * c * d, out)
        live &= np.abs(c * d - 1) > 1e-15
        if not live.any():
            break
    return out


def beta_cdf(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function, element by element, for a and b of at least 1."""
    x, a, b = (np.array(v, float) for v in np.broadcast_arrays(x, a, b))
    out, inside = (x >= 1).astype(float), (x > 0) & (x < 1)
    turned = inside & (x > (a + 1) / (a + b + 2))
    y, p, q = np.where(turned, 1 - x, x)[inside], np.where(turned, b, a)[inside], np.where(turned, a, b)[inside]
    part = (1 - y) * mass(p, p + q - 1, y) * _fraction(y, p, q)
    out[inside] = np.where(turned[inside], 1 - part, part)
    return out


def tail(k, n, p) -> np.ndarray:
    """P(X <= k) of n trials at rate p; 1 for k >= n, 0 for k < 0."""
    k, n, p = (np.array(v, float) for v in np.broadcast_arrays(k, n, p))
    out, inner = (k >= n).astype(float), (k >= 0) & (k < n)
    out[inner] = beta_cdf(1 - p[inner], n[inner] - k[inner], k[inner] + 1)
    return out


def upper(k, n, delta) -> np.ndarray:
    """One-sided exact upper limit of a rate with k failures in n trials; 1 for n <= 0 or k >= n."""
    k, n, delta = (np.array(v, float) for v in np.broadcast_arrays(k, n, delta))
    out, inner = np.ones(len(k)), (n > 0) & (k < n)
    kk, nn, goal = k[inner], n[inner], delta[inner]
    lo, hi = np.zeros(len(kk)), np.ones(len(kk))
    for _ in range(60):
        mid = (lo + hi) / 2
        above = tail(kk, nn, mid) > goal
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    out[inner] = (lo + hi) / 2
    return out


def quantile(prob, n, p) -> np.ndarray:
    """Smallest k with P(X <= k) >= prob."""
    prob, n, p = (np.array(v, float) for v in np.broadcast_arrays(prob, n, p))
    lo, hi = np.full(len(n), -1.0), n.copy()
    while (hi - lo > 1).any():
        mid = np.floor((lo + hi) / 2)
        at = (p > 0) & (p < 1)
        cdf = np.ones(len(n))
        cdf[at] = tail(mid[at], n[at], p[at])
        cdf[p >= 1] = (mid >= n)[p >= 1]
        cdf[mid < 0] = 0
        lo, hi = np.where((cdf < prob) & (hi - lo > 1), mid, lo), np.where((cdf >= prob) & (hi - lo > 1), mid, hi)
    return hi


def _column(f: Callable[..., np.ndarray]):
    """A pandas UDF of three numeric columns; equal argument rows of a batch are computed once."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        rows = np.column_stack([np.asarray(x, float) for x in (a, b, c)])
        known = ~np.isnan(rows).any(axis=1)
        distinct, back = np.unique(rows[known], axis=0, return_inverse=True)
        out = np.full(len(rows), np.nan)
        if len(distinct):
            out[known] = f(*distinct.T)[back.reshape(-1)]
        return pd.Series(out).where(known, None)

    return run


#: Columns of (k, n, p), (k, n, delta) and (prob, n, p).
tail_of, upper_limit, quantile_of = _column(tail), _column(upper), _column(quantile)
