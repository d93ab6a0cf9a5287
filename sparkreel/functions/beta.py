"""The regularised incomplete beta function and its inverse, and exact binomial intervals, without third-party code."""

from __future__ import annotations

import math


def beta_cdf(a: float, b: float, x: float) -> float:
    """I_x(a, b), by Lentz's evaluation of the continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f = c = 1.0
    d = 0.0
    for i in range(2000):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or tiny)
        c = 1 + top / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def beta_quantile(p: float, a: float, b: float) -> float:
    """x with I_x(a, b) = p, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if beta_cdf(a, b, mid) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-16:
            break
    return (lo + hi) / 2


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Exact interval of a share of k in n; the whole range for n = 0."""
    if n == 0:
        return 0.0, 1.0
    tail = (1 - confidence) / 2
    lo = 0.0 if k == 0 else beta_quantile(tail, k, n - k + 1)
    hi = 1.0 if k == n else beta_quantile(1 - tail, k + 1, n - k)
    return lo, hi


def quantile_ranks(n: int, q: float, confidence: float = 0.95) -> tuple[int, int]:
    """0-based ranks that bound the q-quantile of n sorted values."""
    if n <= 1:
        return 0, 0
    tail = (1 - confidence) / 2
    k = min(max(int(q * n), 1), n - 1)
    lo = int(beta_quantile(tail, k, n - k + 1) * n)
    hi = int(beta_quantile(1 - tail, k + 1, n - k) * n)
    return min(max(lo, 0), n - 1), min(max(hi - 1 if hi > 0 else hi, 0), n - 1)
