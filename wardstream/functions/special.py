"""Scalar special functions for closed forms (no SciPy needed)."""

from __future__ import annotations

import math
from functools import cache


@cache
def zeta(s: float) -> float:
    """Riemann zeta for s > 1."""
    return hurwitz(s, 1.0)


def hurwitz(s: float, a: float, terms: int = 64) -> float:
    """Hurwitz zeta, the sum of (a + k)^-s over k >= 0, for s > 1 and a > 0, by Euler-Maclaurin summation from a + k >= ``terms`` on."""
    skip = max(0, math.ceil(terms - a))
    x = a + skip
    out = math.fsum((a + k) ** -s for k in range(skip)) + x ** (1 - s) / (s - 1) + x**-s / 2
    # Bernoulli numbers B2..B12.
    b, c = [1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730], s * x ** (-s - 1)
    for i, bk in enumerate(b):
        out += bk / math.factorial(2 * i + 2) * c
        c *= (s + 2 * i + 1) * (s + 2 * i + 2) / x**2
    return out


def digamma(x: float) -> float:
    """Digamma for x > 0: recurrence up to 10, then the asymptotic series."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / x**2
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def harmonic(n: float) -> float:
    """H_n for n >= 0."""
    return digamma(n + 1) + 0.5772156649015329


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if i and abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1) / a


def beta_quantile(q: float, a: float, b: float) -> float:
    """Inverse of :func:`beta_cdf` by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if beta_cdf(mid, a, b) < q:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact confidence interval of a binomial share."""
    a = (1 - level) / 2
    return (0.0 if k == 0 else beta_quantile(a, k, n - k + 1), 1.0 if k == n else beta_quantile(1 - a, k + 1, n - k))


def binom_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    if k < 0:
        return 0.0
    return 1.0 if k >= n else 1.0 - beta_cdf(p, k + 1, n - k)


def hypergeom_at_least_one(total: int, good: int, draws: int) -> float:
    """P(at least one good) among ``draws`` without replacement."""
    if good <= 0 or draws <= 0:
        return 0.0
    if draws > total - good:
        return 1.0
    none = math.lgamma(total - good + 1) - math.lgamma(total - good - draws + 1) - math.lgamma(total + 1) + math.lgamma(total - draws + 1)
    return -math.expm1(none)


def normal_sf(z: float) -> float:
    """Upper tail of the standard normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_isf(q: float) -> float:
    """The z with P(Z >= z) = q, by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_sf(mid) > q else (lo, mid)
    return hi


def wilson(k: float, n: float, z: float = 1.959963984540054) -> tuple[float, float] | None:
    """Wilson interval; None for n = 0."""
    if not n:
        return None
    p, z2 = k / n, z * z
    mid, half = p + z2 / (2 * n), z * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return max(0.0, (mid - half) / (1 + z2 / n)), min(1.0, (mid + half) / (1 + z2 / n))
