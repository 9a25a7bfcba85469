"""Effect sizes and test statistics as expressions over moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varve.functions.scalars import clip


def pooled_t(n1, m1, v1, n2, m2, v2) -> Column:
    pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    return F.try_divide(m1 - m2, F.sqrt(pooled * (1 / n1 + 1 / n2)))


def welch_t(n1, m1, v1, n2, m2, v2) -> Column:
    return F.try_divide(m1 - m2, F.sqrt(v1 / n1 + v2 / n2))


def welch_df(n1, v1, n2, v2) -> Column:
    a, b = v1 / n1, v2 / n2
    return F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1))


def cohens_d(n1, m1, v1, n2, m2, v2) -> Column:
    """Pooled-SD effect size; 0 for groups under two rows or without spread."""
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    return F.when((n1 < 2) | (n2 < 2) | (pooled <= 0), F.lit(0.0)).otherwise((m1 - m2) / pooled)


def fisher_z(r1, n1, r2, n2, bound=0.9999) -> Column:
    """Difference of two independent correlations on the z scale."""
    if bound is not None:
        r1, r2 = clip(r1, -bound, bound), clip(r2, -bound, bound)
    spread = F.when((n1 > 3) & (n2 > 3), F.sqrt(F.try_divide(F.lit(1.0), n1 - 3) + F.try_divide(F.lit(1.0), n2 - 3)))
    return (F.atanh(r1) - F.atanh(r2)) / spread


def dependent_z(r1, r2, r12, n) -> Column:
    """Meng, Rosenthal and Rubin (1992) z for two correlations sharing a variable."""
    mean_sq = (r1 * r1 + r2 * r2) / 2
    f = clip(F.try_divide(1 - r12, 2 * (1 - mean_sq)), 0, 1)
    h = F.try_divide(1 - f * mean_sq, 1 - mean_sq)
    return (F.atanh(r1) - F.atanh(r2)) * F.sqrt(F.try_divide(n - 3, 2 * (1 - r12) * h))


def r_to_t(r, n) -> Column:
    return r * F.sqrt(F.try_divide(n - 2, 1 - r * r))


def yates_chi2(a, b, c, d) -> Column:
    """Chi-square of a 2x2 table with the continuity correction, each cell moved by at most 0.5 or the gap."""
    n = a + b + c + d
    gap = F.abs(a * d - b * c)
    moved = F.greatest(gap - n / 2, F.lit(0.0))
    return F.try_divide(n * moved * moved, (a + b) * (c + d) * (a + c) * (b + d))
