"""Tail areas of the t and normal distributions, for coefficient tables."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if not math.isfinite(t) or df <= 0:
        return 0.0 if math.isinf(t) else float("nan")
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _upper(two_sided, alpha: float) -> float:
    """x with two_sided(x) = alpha, by bisection."""
    low, high = 0.0, 1.0
    while two_sided(high) > alpha:
        low, high = high, high * 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        low, high = (mid, high) if two_sided(mid) > alpha else (low, mid)
    return 0.5 * (low + high)


def t_critical(level: float, df: float) -> float:
    """Half width, in standard errors, of a two-sided interval of that level."""
    return _upper(lambda x: t_two_sided(x, df), 1.0 - level)


def normal_critical(level: float) -> float:
    return _upper(normal_two_sided, 1.0 - level)
