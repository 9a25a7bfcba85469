"""Tail probabilities and quantiles for result tables (one row per test, never per data row)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz recurrence."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    scale = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return scale * _beta_fraction(a, b, x) / a
    return 1.0 - scale * _beta_fraction(b, a, 1.0 - x) / b


def gamma_sf(x: float, a: float) -> float:
    """Upper regularised incomplete gamma function: series below a+1, continued fraction above."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    value = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return scale * value


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def f_upper(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def chi2_upper(x: float, df: float) -> float:
    return gamma_sf(x / 2.0, df / 2.0)


def f_quantile(p: float, d1: float, d2: float) -> float:
    """Value whose lower tail is p, by bisection."""
    low, high = 0.0, 1.0
    while f_upper(high, d1, d2) > 1.0 - p and high < 1e12:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if f_upper(mid, d1, d2) > 1.0 - p else (low, mid)
    return (low + high) / 2.0


def _usable(*values) -> bool:
    return all(v is not None and not math.isnan(v) for v in values)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) if _usable(a, b) and b > 0 else None for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def z_pvalue(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(a) if _usable(a) else None for a in z], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_upper(a, b) if _usable(a, b) else None for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_upper(a, b, c) if _usable(a, b, c) else None for a, b, c in zip(f, d1, d2)], dtype="float64")


@F.pandas_udf(DoubleType())
def f_ppf(p: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_quantile(a, b, c) if _usable(a, b, c) else None for a, b, c in zip(p, d1, d2)], dtype="float64")
