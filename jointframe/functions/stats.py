"""Numerical helpers that run inside Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    rounds = 10_000 + 20 * math.isqrt(int(a + b))
    for m in range(1, rounds):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"the fraction for {a}, {b}, {x} does not settle")


def _beta_front(a: float, b: float, x: float) -> float:
    """x^a (1-x)^b / B(a, b). For large a and b by Stirling's series, which subtracts no large terms."""
    if min(a, b) < 1000.0:
        return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    n = a + b

    def rest(z: float) -> float:
        return 1.0 / (12.0 * z) - 1.0 / (360.0 * z**3)

    shape = a * math.log1p((x * n - a) / a) + b * math.log1p(((1.0 - x) * n - b) / b)
    return math.exp(shape + 0.5 * math.log(a * b / n) - 0.5 * math.log(2.0 * math.pi) + rest(n) - rest(a) - rest(b))


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = _beta_front(a, b, x)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def binomial_cdf(k: int, n: int, p: float) -> float:
    return 0.0 if k < 0 else 1.0 if k >= n else 1.0 - beta_cdf(k + 1.0, float(n - k), p)


def binomial_test(k: int, n: int, p: float) -> float:
    """Two-sided exact p-value: mass of all outcomes no likelier than k. Needs O(log n) steps."""
    if p <= 0.0 or p >= 1.0:
        return 1.0 if k == n * p else 0.0

    def log_pmf(i: int) -> float:
        return (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))

    bar = log_pmf(k) + 1e-7
    mode = min(n, max(0, math.floor((n + 1) * p)))
    if log_pmf(mode) <= bar:
        return 1.0
    if k < mode:  # the far tail starts at the first i > mode with pmf <= bar
        lo, hi = mode, n + 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if log_pmf(mid) > bar else (lo, mid)
        return min(1.0, binomial_cdf(k, n, p) + 1.0 - binomial_cdf(hi - 1, n, p))
    lo, hi = -1, mode
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if log_pmf(mid) > bar else (mid, hi)
    return min(1.0, binomial_cdf(lo, n, p) + 1.0 - binomial_cdf(k - 1, n, p))


def binomial_interval(k: int, n: int, alpha: float) -> tuple[float, float]:
    """All p whose exact two-sided test keeps k successes of n, by bisection towards each end."""
    share = k / n

    def edge(inside: float, outside: float) -> float:
        for _ in range(80):
            mid = (inside + outside) / 2
            inside, outside = (mid, outside) if binomial_test(k, n, mid) >= alpha else (inside, mid)
        return (inside + outside) / 2

    return (0.0 if k == 0 else edge(share, 0.0)), (1.0 if k == n else edge(share, 1.0))


INTERVAL = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])


@F.pandas_udf(INTERVAL)
def exact_interval(k: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    """Exact interval per row; meant for one row per study."""
    return pd.DataFrame([binomial_interval(int(a), int(b), float(c)) for a, b, c in zip(k, n, alpha)], columns=["low", "high"])


@F.pandas_udf(T.DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 · 2·LCS / (len a + len b), with the longest common subsequence by bit-parallel rows."""
    def one(x: str, y: str) -> float:
        if not x and not y:
            return 100.0
        at: dict[str, int] = {}
        for i, ch in enumerate(x):
            at[ch] = at.get(ch, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row = full
        for ch in y:
            hit = row & at.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        return 200.0 * (len(x) - row.bit_count()) / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def bezier_value(t: pd.Series, x0: pd.Series, x1: pd.Series, x2: pd.Series, x3: pd.Series,
                 y0: pd.Series, y1: pd.Series, y2: pd.Series, y3: pd.Series) -> pd.Series:
    """y of a cubic segment where x(s) = t; x must rise with s, so bisection on whole batches finds s. Rows without t cost nothing."""
    out, asked = np.full(len(t), np.nan), t.notna().to_numpy()
    if not asked.any():
        return pd.Series(out)
    at, *points = [c.to_numpy()[asked].astype(np.float64) for c in (t, x0, x1, x2, x3, y0, y1, y2, y3)]

    def cubic(s: np.ndarray, p0: np.ndarray, p1: np.ndarray, p2: np.ndarray, p3: np.ndarray) -> np.ndarray:
        r = 1 - s
        return r * r * r * p0 + 3 * r * r * s * p1 + 3 * r * s * s * p2 + s * s * s * p3

    lo, hi = at * 0.0, at * 0.0 + 1.0
    for _ in range(60):
        s = (lo + hi) / 2
        low = cubic(s, *points[:4]) < at
        lo, hi = np.where(low, s, lo), np.where(low, hi, s)
    out[asked] = cubic((lo + hi) / 2, *points[4:])
    return pd.Series(out)
