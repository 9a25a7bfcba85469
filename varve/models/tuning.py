"""Choosing a regression's settings inside each outer training set, from the outer folds' own passes.

Every row has an inner fold beside its outer one (families together in both). One pass sums cross products by (run, inner fold);
the training moments of an inner split are the run's total less one inner fold, so that all splits and all linear candidates
are solved without reading the data again: one eigendecomposition serves a split's ridge penalties, and the elastic net goes
along its penalties from the end of the one before. Support vector candidates are fits over the same rows, none copied.
Only a score by absolute errors needs rows once more: one pass of matrix products for all candidates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.models import gram as G
from varve.models.registry import linear_model, parameter_grid, settings
from varve.models.svr import Variant

#: Scores by which candidates are compared, larger is better; the first two follow from sums, the third needs rows.
SCORES = ("pearson_r", "neg_mse", "neg_mae")
_SUMS = ("n", "sp", "spp", "sy", "syy", "spy")


def label(params: dict) -> str:
    """How the choices name a candidate."""
    return ", ".join(f"{k}={v}" for k, v in params.items()) or "default"


def linear_candidates(grid: dict, config: dict | None = None) -> dict[str, list[tuple[str, G.Linear]]]:
    """{model: [(label, model with these settings)]} for the linear models of `grid` ({model: {setting: values}})."""
    out = {}
    for name in grid:
        if name != "svr":
            points = parameter_grid(grid[name])
            out[name] = [(label(p), G.Linear(f"{name}[{label(p)}]", *_penalties(name, {**settings(name, config), **p}))) for p in points]
    return out


def _penalties(name: str, s: dict) -> tuple[float, float]:
    model = linear_model(name, {name: s})
    return model.alpha, model.l1


def svr_candidates(grid: dict, config: dict | None = None) -> list[tuple[str, float, float]]:
    base = settings("svr", config)
    return [(label(p), float({**base, **p}["C"]), float({**base, **p}["epsilon"])) for p in parameter_grid(grid["svr"])]


def inner_fits(table: DataFrame, features, covariates, candidates: dict, groups=(), residualize=True, part="inner") -> DataFrame:
    """(groups..., run, inner, model, candidate, place, coef, n, sp, spp, sy, syy, spy): every linear candidate fitted without one inner fold,
    with its sums on that fold. `table`: cross products by (groups, run, part, side) with one target.

    The target is less the covariate terms of the whole outer training set, as the candidates' final fit sees it. Row weights do
    not enter the tuning. An inner fold that has no rows in a run, or all of them, is left out.
    """
    groups, p, q = list(groups), len(features), len(covariates)
    kinds = dict(table.dtypes)
    names = [*groups, "run", part, "model", "candidate", "place", "coef", *_SUMS]
    schema = ", ".join([f"`{g}` {kinds[g]}" for g in groups] + [f"run int, `{part}` int, model string, candidate string, place int, coef array<double>"] + [f"{c} double" for c in _SUMS])
    columns = list(range(1, 1 + p))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[g].iloc[0] for g in groups] + [int(pdf["run"].iloc[0])]
        cube = {int(v): G.Moments.read(rows, 1 + p + q, 2 + p + q) for v, rows in pdf.groupby(part)}
        if not cube:
            return pd.DataFrame(columns=names)
        total = None
        for m in cube.values():
            total = m if total is None else total + m
        cov = [0, *range(1 + p, 1 + p + q)] if residualize and q else [0]
        terms = G.residualizer(total, cov)
        total = total.less(cov, terms)
        rows = []
        for v, held in sorted(cube.items()):
            held = held.less(cov, terms)
            train = total - held
            if train.xx[0, 0] < 0.5 or held.xx[0, 0] < 0.5:
                continue
            for model, points in candidates.items():
                solver = G.Solver(train, columns)
                # Strong penalties first: few coefficients move from one point to the next.
                for place in sorted(range(len(points)), key=lambda i: (points[i][1].l1, -points[i][1].alpha)):
                    beta = solver.solve(points[place][1])
                    sums = G.held_out_sums(held, [0, *columns], beta)
                    rows.append([*key, v, model, points[place][0], place, beta[:, 0].tolist(), *[float(sums[c][0]) for c in _SUMS]])
        return pd.DataFrame(rows, columns=names)

    return table.where("side = 'train'").groupBy(*groups, "run").applyInPandas(solve, schema)


def score_rows(rows: DataFrame, features, y: str, keys, part: str, fits: dict) -> DataFrame:
    """(keys..., part, model, candidate, place, n, sp, spp, sy, syy, spy, sae) from rows, for {(key, part): [(model, candidate, place, coef)]}.

    `keys` and `part` say which candidates a row is scored by: those fitted without its inner fold. One pass; a batch meets its candidates in
    one matrix product.
    """
    features, keys = list(features), list(keys)
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in [*keys, part]] + ["model string, candidate string, place int"] + [f"{c} double" for c in (*_SUMS, "sae")])
    shared = rows.sparkSession.sparkContext.broadcast({k: ([f[:3] for f in some], np.array([f[3] for f in some], float).T) for k, some in fits.items()})
    picked = rows.select(*keys, part, *[F.col(c).cast("double").alias(c) for c in [*features, y]]).dropna("any", subset=[*features, y])

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for key, mine in pdf.groupby([*keys, part], sort=False):
                place = ((*key[:-1],), int(key[-1]))
                if place not in shared.value:
                    continue
                beta = shared.value[place][1]
                yhat = np.column_stack([np.ones(len(mine)), mine[features].to_numpy(float)]) @ beta
                t = mine[y].to_numpy(float)[:, None]
                n = np.full(beta.shape[1], float(len(mine)))
                block = np.stack([n, yhat.sum(0), (yhat**2).sum(0), n / len(mine) * t.sum(), n / len(mine) * (t**2).sum(), (yhat * t).sum(0), np.abs(yhat - t).sum(0)])
                sums[place] = sums.get(place, 0.0) + block
        for (key, v), block in sums.items():
            frame = pd.DataFrame(shared.value[key, v][0], columns=["model", "candidate", "place"])
            for name, value in zip([*keys, part], [*key, v]):
                frame[name] = value
            for name, values in zip((*_SUMS, "sae"), block):
                frame[name] = values
            yield frame[[*keys, part, "model", "candidate", "place", *_SUMS, "sae"]]

    names = [*keys, part, "model", "candidate", "place"]
    return picked.mapInPandas(partial, schema).groupBy(*names).agg(*[F.sum(c).alias(c) for c in (*_SUMS, "sae")])


def choose(sums: DataFrame, keys, scoring: str) -> DataFrame:
    """(keys..., model, candidate, place, score): of each model the candidate with the best mean score over the inner folds.

    Equal scores go to the candidate that the grid lists first. An inner fold on which the predictions or the target are constant
    has a correlation of 0.
    """
    c = F.col
    vp, vy = c("spp") - c("sp") * c("sp") / c("n"), c("syy") - c("sy") * c("sy") / c("n")
    flat = (vp / c("n") < 1e-20) | (vy / c("n") < 1e-20)
    score = {
        "pearson_r": F.when(flat, F.lit(0.0)).otherwise(F.try_divide(c("spy") - c("sp") * c("sy") / c("n"), F.sqrt(vp * vy))),
        "neg_mse": -(c("syy") - 2 * c("spy") + c("spp")) / c("n"),
    }
    if "sae" in sums.columns:
        score["neg_mae"] = -c("sae") / c("n")
    if scoring not in score:
        raise ValueError(f"scoring {scoring!r} is none of {SCORES}")
    mean = sums.withColumn("_score", score[scoring]).groupBy(*keys, "model", "candidate", "place").agg(F.avg("_score").alias("score"))
    order = Window.partitionBy(*keys, "model").orderBy(F.desc(F.round("score", 12)), "place")
    return mean.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def svr_variants(candidates, parts) -> Callable:
    """For `fit_svr_variants`: every candidate without every inner fold, named `place|inner`."""
    every = [Variant(f"{place}|{v}", C, epsilon, v) for v in parts for place, (_, C, epsilon) in enumerate(candidates)]
    return lambda key: every
