"""Statistics of all pairs of columns from tiles of moments, without a row per pair.

A column is cut into its values (null as 0, after a shift by the column's mean) and a mask of what is known. A sum over the rows in
which both columns of a pair are known is then a product of two matrices, for all pairs of two groups of columns (a tile) at once. Tasks
add up their tiles over Arrow batches; tiles are summed in two steps and solved where they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns in a side of a tile; tasks over which the partial sums of a tile are first added up.
TILE, SALTS = 64, 64

#: Which products a statistic needs: powers of the left column, the right column and the target.
CORRELATION = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (2, 0, 0), (0, 2, 0), (1, 1, 0)]
INTERACTION = [(i, j, 0) for i in range(3) for j in range(3)] + [(i, j, 1) for i in range(2) for j in range(2)] + [(0, 0, 2)]


def pair_tiles(df: DataFrame, left, right, powers, solve: Callable, out_schema: str, groups=(), target: str | None = None, upper=False, tile=None) -> DataFrame:
    """(groups..., what `solve` gives) for all left x right columns; with `upper` only pairs in which left comes before right in the lists.

    `solve(moments, names_left, names_right)` gets {(i, j, k): matrix of sums of a^i b^j y^k} and returns a frame with the columns of
    `out_schema` after a and b, one row a pair in row-major order. Rows with a null target are left out.
    """
    left, right, groups, tile = list(left), list(right), list(groups), tile or TILE
    columns = list(dict.fromkeys([*left, *right]))
    numbers = [*columns, *([target] if target else [])]
    mean = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
    names = [f"_x{i}" for i in range(len(numbers))]
    rows = df.select(*groups, *[(F.col(c).cast("double") - F.lit(mean[f"m{i}"] or 0.0)).alias(n) for i, (c, n) in enumerate(zip(numbers, names))])
    if target:
        rows = rows.where(F.col(names[-1]).isNotNull())
    place = {c: i for i, c in enumerate(columns)}
    sides = [[np.array([place[c] for c in side[at : at + tile]]) for at in range(0, len(side), tile)] for side in (left, right)]
    tiles = [(i, j) for i in range(len(sides[0])) for j in range(len(sides[1])) if not upper or i <= j]
    kinds = dict(df.dtypes)
    key_schema = [f"`{g}` {kinds[g]}" for g in groups]

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            parts = batch.groupby(groups, sort=False, dropna=False) if groups else [((), batch)]
            for key, pdf in parts:
                key = tuple(None if pd.isna(k) else k for k in key)
                x = pdf[names[: len(columns)]].to_numpy(dtype=float)
                y = pdf[names[-1]].to_numpy(dtype=float)[:, None] if target else None
                known = ~np.isnan(x)
                x = np.where(known, x, 0.0)
                raised = [known.astype(float), x, x * x]
                for i, j in tiles:
                    a, b = sides[0][i], sides[1][j]
                    block = np.stack([(raised[p][:, a] * y**r if r else raised[p][:, a]).T @ raised[q][:, b] for p, q, r in powers]).ravel()
                    sums[key, i, j] = sums.get((key, i, j), 0.0) + block
        for (key, i, j), block in sums.items():
            yield pd.DataFrame({**{g: [k] for g, k in zip(groups, key)}, "_i": np.array([i], "int32"), "_j": np.array([j], "int32"), "_sums": [block]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf["_sums"].to_numpy()), axis=0)
        return pdf.iloc[:1].assign(_sums=[total])[[*groups, "_i", "_j", "_sums"]]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        a, b = sides[0][i], sides[1][j]
        total = np.sum(np.stack(pdf["_sums"].to_numpy()), axis=0).reshape(len(powers), len(a), len(b))
        out = solve(dict(zip(powers, total)))
        out.insert(0, "a", np.repeat([columns[c] for c in a], len(b)))
        out.insert(1, "b", np.tile([columns[c] for c in b], len(a)))
        for at, g in enumerate(groups):
            out.insert(at, g, pdf[g].iloc[0])
        if upper:
            row, col = np.indices((len(a), len(b)))
            out = out[((i * tile + row) < (j * tile + col)).ravel()]
        return out

    tile_schema = ", ".join([*key_schema, "_i int, _j int, _sums array<double>"])
    keys = [*groups, "_i", "_j"]
    summed = rows.mapInPandas(partial, tile_schema).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    summed = summed.groupBy(*keys, "_salt").applyInPandas(add, tile_schema)
    return summed.groupBy(*keys).applyInPandas(finish, ", ".join([*key_schema, "a string, b string", out_schema]))


def solve_correlations(m: dict) -> pd.DataFrame:
    """r and n of every pair; r null under two rows, or where the spread of a side is lost beside its distance from the column's mean."""
    n = m[0, 0, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        va, vb = m[2, 0, 0] - m[1, 0, 0] ** 2 / n, m[0, 2, 0] - m[0, 1, 0] ** 2 / n
        cov = m[1, 1, 0] - m[1, 0, 0] * m[0, 1, 0] / n
        good = (n >= 2) & (va > 1e-12 * m[2, 0, 0]) & (vb > 1e-12 * m[0, 2, 0])
        r = np.where(good, np.clip(cov / np.sqrt(va * vb), -1.0, 1.0), np.nan)
    return pd.DataFrame({"r": [None if np.isnan(v) else v for v in r.ravel()], "n": n.ravel().round().astype(np.int64)})


def solve_interactions(m: dict) -> pd.DataFrame:
    """Coefficient, t and r2 of a*b in y ~ 1 + a + b + a*b for every pair, over rows in which all three are known.

    A shift of a and b changes neither. Null where the four terms are not independent or no degree of freedom is left.
    """
    n = m[0, 0, 0].ravel()
    order = [(0, 0), (1, 0), (0, 1), (1, 1)]
    a = np.empty((len(n), 4, 4))
    for s, (p, q) in enumerate(order):
        for t, (u, v) in enumerate(order):
            a[:, s, t] = m[p + u, q + v, 0].ravel()
    b = np.stack([m[p, q, 1].ravel() for p, q in order], axis=1)
    yy, sy = m[0, 0, 2].ravel(), m[0, 0, 1].ravel()
    scale = np.sqrt(np.where(np.einsum("kii->ki", a) > 0, np.einsum("kii->ki", a), 1.0))
    unit = a / scale[:, :, None] / scale[:, None, :]
    ok = (n > 4) & (np.linalg.matrix_rank(unit, tol=1e-10, hermitian=True) == 4)
    unit[~ok] = np.eye(4)
    inverse = np.linalg.inv(unit) / scale[:, :, None] / scale[:, None, :]
    beta = np.einsum("kij,kj->ki", inverse, b)
    rss = np.maximum(yy - (b * beta).sum(axis=1), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        tss = yy - sy**2 / n
        se = np.sqrt(np.maximum(rss / (n - 4) * inverse[:, 3, 3], 0.0))
        t = np.where(se > 0, beta[:, 3] / se, np.nan)
        r2 = np.where(tss > 0, 1 - rss / tss, np.nan)
    out = pd.DataFrame({c: np.where(ok, v, np.nan) for c, v in (("beta_interaction", beta[:, 3]), ("t", t), ("r2", r2))})
    out = out.astype(object).where(out.notna(), None)
    return out.assign(n=n.round().astype(np.int64))
