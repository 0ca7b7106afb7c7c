"""Normal distribution, exact binomial and expected maxima, without SciPy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

EULER_GAMMA = 0.5772156649015329


def cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def expected_max(n: int) -> float:
    """Expected maximum of n independent standard normals, by Simpson's rule on n*x*phi(x)*Phi(x)^(n-1) in logs."""
    if n <= 1:
        return 0.0
    x = np.linspace(-12, 12, 24_001)
    tail = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    with np.errstate(divide="ignore"):
        log = math.log(n) - x * x / 2 - 0.5 * math.log(2 * math.pi) + (n - 1) * np.log(tail)
    y = x * np.exp(log)
    h = x[1] - x[0]
    return float(h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))


def expected_max_closed(n: int) -> float:
    """The usual closed form with Euler's constant."""
    return 0.0 if n <= 1 else (1 - EULER_GAMMA) * quantile(1 - 1 / n) + EULER_GAMMA * quantile(1 - 1 / (n * math.e))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided p-value of k hits in n fair trials: twice the smaller tail, at most 1."""
    if n == 0:
        return 1.0
    low = min(k, n - k)
    log2n = n * math.log(2)
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - log2n) for i in range(low + 1))
    return min(1.0, 2 * tail)
