"""Tails of the chi-square, F and normal distributions, without outside libraries."""

from __future__ import annotations

import math


def gamma_p(a: float, x: float) -> float:
    """Regularized lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:  # series
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a  # continued fraction
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi_square_tail(x: float, degrees: float) -> float:
    """P(chi-square > x)."""
    return 1.0 if x <= 0 else max(0.0, 1 - gamma_p(degrees / 2, x / 2)) if x < 600 else _upper(degrees / 2, x / 2)


def _upper(a: float, x: float) -> float:
    return math.exp(-x + (a - 1) * math.log(x) - math.lgamma(a))


def normal_tail(z: float) -> float:
    """P(|Z| > z), both sides."""
    return math.erfc(abs(z) / math.sqrt(2))


def poisson_truncated(rate: float, most: int) -> list[float]:
    """Poisson probabilities of 0..most, scaled to sum to one."""
    raw = [math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate > 0 else float(k == 0) for k in range(most + 1)]
    total = sum(raw)
    return [p / total for p in raw]
