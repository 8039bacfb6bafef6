"""Special functions and distributions that the statistics need, in NumPy and plain Python."""

from __future__ import annotations

import math

import numpy as np


def digamma(x: np.ndarray | float) -> np.ndarray:
    """Digamma of positive numbers: recurrence up to 6, then the asymptotic series."""
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out = np.where(small, out - 1 / np.where(small, x, 1), out)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def f_survival(f: float, d1: float, d2: float) -> float:
    """P(F > f) of the F distribution."""
    if math.isnan(f) or d1 <= 0 or d2 <= 0:
        return math.nan
    return 0.0 if math.isinf(f) else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def kolmogorov_survival(x: float) -> float:
    """P(K > x) of Kolmogorov's limit distribution."""
    if x <= 0:
        return 1.0
    if x < 1.18:
        y = math.exp(-math.pi**2 / (8 * x * x))
        return 1 - math.sqrt(2 * math.pi) / x * (y + y**9 + y**25 + y**49)
    return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))


def ks_p_value(d: float, n: float) -> float:
    """p value of a KS distance with effective size n (Stephens' correction of the limit distribution)."""
    root = math.sqrt(n)
    return kolmogorov_survival((root + 0.12 + 0.11 / root) * d) if n > 0 and not math.isnan(d) else math.nan
