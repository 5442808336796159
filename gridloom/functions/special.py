"""Tail probabilities in NumPy, for the few statistics that SQL has no function for."""

from __future__ import annotations

import math


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or tiny)
            c = (1 + k / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f / a


def gamma_q(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < s + 1:
        term = total = 1 / s
        n = s
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + s * math.log(x) - math.lgamma(s))
    b, c = x + 1 - s, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        a = -i * (i - s)
        b += 2
        d = 1 / (a * d + b)
        c = b + a / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + s * math.log(x) - math.lgamma(s))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_tail(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: all tables that are no likelier than this one."""
    def log(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    row, other, col = a + b, c + d, a + c
    whole = log(row + other, col)
    p = [math.exp(log(row, k) + log(other, col - k) - whole) for k in range(max(0, col - other), min(row, col) + 1)]
    own = p[a - max(0, col - other)]
    return min(1.0, sum(x for x in p if x <= own * (1 + 1e-7)))
