"""Scalar functions that analytics rely on, as column expressions or plain numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def logit(mu: Column) -> Column:
    return F.log(mu / (1 - mu))


def inverse_logit(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def log_gamma(x: Column) -> Column:
    """log Gamma(x) for x > 0: Stirling's series at x + 8, carried back by the recurrence; 1e-13 near 1."""
    z = x + 8
    r = 1 / z
    series = r / 12 - r * r * r / 360 + F.pow(r, F.lit(5)) / 1260 - F.pow(r, F.lit(7)) / 1680 + F.pow(r, F.lit(9)) / 1188
    below = x
    for k in range(1, 8):
        below = below * (x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(below)


def binomial_log_density(y: Column, mu: Column) -> Column:
    """Of y successes in one trial."""
    return F.when(y == 1, F.log(mu)).when(y == 0, F.log1p(-mu)).otherwise(y * F.log(mu) + (1 - y) * F.log1p(-mu))


def poisson_log_density(y: Column, mu: Column) -> Column:
    return y * F.log(mu) - mu - log_gamma(y + 1)


def normal_tail(z: float) -> float:
    """Two-sided P(|Z| > z)."""
    return math.erfc(abs(z) / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, tiny = 1.0, 0.0, 1e-300
    f = 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def student_tail(t: float, df: float) -> float:
    """Two-sided P(|T| > t)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))
