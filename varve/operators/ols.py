"""Least squares from cross-product sums, one aggregate for any number of groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.functions.pvalues import t_two_sided


def ols(df: DataFrame, y: str, terms, groups=()) -> DataFrame:
    """(groups..., term, beta, se, t, p, n, r2) for y ~ 1 + terms, per group, over complete rows.

    Few terms per model: every product is a generated sum, combined map-side. Values are shifted by the overall
    means first, so large offsets do not cancel.
    """
    terms, groups = list(terms), list(groups)
    cols = [*terms, y]
    complete = df.dropna("any", subset=cols).select(*groups, *[F.col(c).cast("double").alias(c) for c in cols])
    means = complete.agg(*[F.avg(c).alias(c) for c in cols]).first()
    shift = [means[c] or 0.0 for c in cols]
    shifted = [F.col(c) - F.lit(m) for c, m in zip(cols, shift)]
    aggs = [F.count(F.lit(1)).cast("double").alias("n")]
    aggs += [F.sum(s).alias(f"s{i}") for i, s in enumerate(shifted)]
    aggs += [F.sum(shifted[i] * shifted[j]).alias(f"q{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    sums = complete.groupBy(*groups).agg(*aggs)
    kinds = dict(complete.dtypes)
    schema = ", ".join(
        [f"`{g}` {kinds[g]}" for g in groups]
        + ["term string", "beta double", "se double", "t double", "p double", "n long", "r2 double"]
    )

    def solve(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                rows += [[*[r[g] for g in groups], *fit] for fit in _solve(r, terms, shift)]
            yield pd.DataFrame(rows, columns=[*groups, "term", "beta", "se", "t", "p", "n", "r2"])

    return sums.mapInPandas(solve, schema)


def _solve(r, terms, shift):
    p, n = len(terms), r["n"]
    gram = np.zeros((p + 2, p + 2))
    gram[0, 0] = n
    for i in range(p + 1):
        gram[0, i + 1] = gram[i + 1, 0] = r[f"s{i}"]
        for j in range(i, p + 1):
            gram[i + 1, j + 1] = gram[j + 1, i + 1] = r[f"q{i}_{j}"]
    a, b, yy = gram[: p + 1, : p + 1], gram[: p + 1, p + 1], gram[p + 1, p + 1]
    names = ["intercept", *terms]
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    unit = a / np.outer(scale, scale)
    if n <= p + 1 or np.linalg.matrix_rank(unit, tol=1e-10) < p + 1:
        return [[t, None, None, None, None, int(n), None] for t in names]
    inverse = np.linalg.inv(unit) / np.outer(scale, scale)
    beta = inverse @ b
    rss = max(yy - b @ beta, 0.0)
    tss = yy - gram[0, p + 1] ** 2 / n
    sigma2, df = rss / (n - p - 1), n - p - 1
    # Undo the shift: only the intercept and its variance change.
    back = np.eye(p + 1)
    back[0, 1:] = -np.asarray(shift[:p])
    cov = back @ inverse @ back.T * sigma2
    beta = back @ beta
    beta[0] += shift[p]
    se = np.sqrt(np.maximum(np.diag(cov), 0.0))
    r2 = 1.0 - rss / tss if tss > 0 else None
    out = []
    for name, bb, ss in zip(names, beta, se):
        t = bb / ss if ss > 0 else None
        out.append([name, bb, ss, t, t_two_sided(t, df) if t is not None else None, int(n), r2])
    return out
