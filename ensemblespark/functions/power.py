"""Critical values and detectable effects of a paired t test, on numpy alone."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

ALPHA = 0.05


@cache
def _grid(df: int) -> tuple[np.ndarray, np.ndarray]:
    """Points s and weights of the distribution of sqrt(chi2(df) / df)."""
    top = 1 + 12 / math.sqrt(2 * df)
    s = (np.arange(4000) + 0.5) * top / 4000
    w = np.exp((df - 1) * np.log(s) - df * s * s / 2)
    return s, w / w.sum()


#: Coefficients of a rational approximation of the error function, good to 1.5e-7.
SLOPE, TERMS = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + SLOPE * z)
    upper = 0.5 * sum(a * t ** (i + 1) for i, a in enumerate(TERMS)) * np.exp(-z * z)
    return np.where(x > 0, 1 - upper, upper)


def _solve(f, lo: float, hi: float) -> float:
    """Where a rising f crosses 0."""
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


@cache
def t_critical(df: int, alpha: float = ALPHA) -> float:
    s, w = _grid(df)
    return _solve(lambda t: alpha - 2 * float(w @ _phi(-t * s)), 0.0, 400.0)


@cache
def detectable(n: int, power: float = 0.8, alpha: float = ALPHA) -> float:
    """Least effect, in standard deviations of the differences, that n pairs show with this power."""
    if n < 2:
        return math.inf
    s, w = _grid(n - 1)
    t = t_critical(n - 1, alpha)
    reached = lambda d: float(w @ (_phi(d * math.sqrt(n) - t * s) + _phi(-d * math.sqrt(n) - t * s)))
    return _solve(lambda d: reached(d) - power, 0.0, 400.0)
