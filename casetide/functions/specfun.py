"""Distribution functions in plain Python, for the driver's small computations."""

from __future__ import annotations

import math


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def _inverse(f, target: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        if f(mid) < target:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def beta_ppf(q: float, a: float, b: float) -> float:
    return _inverse(lambda x: betainc(a, b, x), q, 0.0, 1.0)


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_ppf(q: float, df: float) -> float:
    if q < 0.5:
        return -t_ppf(1 - q, df)
    hi = 1.0
    while 1 - t_sf(hi, df) < q and hi < 1e12:
        hi *= 2
    return _inverse(lambda t: 1 - t_sf(t, df), q, 0.0, hi)


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def norm_ppf(q: float) -> float:
    return _inverse(lambda z: 1 - norm_sf(z), q, -40.0, 40.0)


def binom_cdf(k: int, n: int, p: float) -> float:
    return 0.0 if k < 0 else 1.0 if k >= n else betainc(n - k, k + 1, 1 - p)


def binom_sf(k: int, n: int, p: float) -> float:
    """Chance of more than ``k``."""
    return 1.0 if k < 0 else 0.0 if k >= n else betainc(k + 1, n - k, p)


def binom_pmf(k: int, n: int, p: float) -> float:
    if p in (0.0, 1.0):
        return float(k == n * p)
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def binom_test(k: int, n: int, p: float) -> float:
    """Two-sided p: the chance of all outcomes no likelier than the one seen."""
    seen = binom_pmf(k, n, p) * (1 + 1e-7)
    return min(1.0, sum(x for x in (binom_pmf(i, n, p) for i in range(n + 1)) if x <= seen))


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    tail = (1 - level) / 2
    return (0.0 if k == 0 else beta_ppf(tail, k, n - k + 1), 1.0 if k == n else beta_ppf(1 - tail, k + 1, n - k))
