"""Tail probabilities for the few rows of a result table (statistics come from Spark aggregates)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T

TINY = 1e-300


def _fraction(term, limit: int = 10_000) -> float:
    """Modified Lentz evaluation of 1 + a1/(1 + a2/(1 + …))."""
    f = c = 1.0
    d = 0.0
    for i in range(1, limit):
        a = term(i)
        d = 1.0 + a * d
        d = 1.0 / (d if abs(d) > TINY else TINY)
        c = 1.0 + a / c
        c = c if abs(c) > TINY else TINY
        f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return f


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(b, a, 1.0 - x)

    def term(i: int) -> float:
        m = i // 2
        if i % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) / (a * _fraction(term))


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        total = part = 1.0 / a
        k = a
        while abs(part) > abs(total) * 1e-17:
            k += 1
            part *= x / k
            total += part
        return max(0.0, 1.0 - total * math.exp(front))
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    f = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = step * d + b
        d = 1 / (d if abs(d) > TINY else TINY)
        c = b + step / c
        c = c if abs(c) > TINY else TINY
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(front) * f


def _each(function, *series: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else function(*row) for row in zip(*series)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, freedom: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return _each(lambda t, v: beta_tail(v / 2, 0.5, v / (v + t * t)), t, freedom)


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, freedom: pd.Series) -> pd.Series:
    return _each(lambda x, v: gamma_tail(v / 2, x / 2), x, freedom)


@F.pandas_udf(T.DoubleType())
def z_pvalue(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal."""
    return _each(lambda z: math.erfc(abs(z) / math.sqrt(2)), z)
