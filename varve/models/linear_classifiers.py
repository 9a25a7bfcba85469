"""Logistic and hinge-loss classifiers, fitted for all runs, inner folds, settings and balanced subsets in shared passes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.models.grouped import settle
from varve.models.registry import DEFAULTS
from varve.models.svr import Fit
from varve.operators.shuffles import donors, number_rows, round_keys
from varve.session import stage

#: Classifiers that this module fits; their scores are probabilities or margins.
LINEAR = ("logistic", "svm")
# The constant score of a fit whose rows are all of one class, as a logit and as a margin.
ONE_CLASS = {"logistic": 20.0, "svm": 1.0}


@dataclass
class LogisticFit:
    """Newton's method for |beta|^2 / 2 + C * sum(weight * log loss), the intercept unpenalised; `C` None: no penalty.

    A step that raises the objective is halved. The fit ends when the Newton decrement, which bounds the distance of its
    coefficients from the optimum near it, is below `tol` times their length; the last step is taken all the same.
    """

    b: np.ndarray
    C: float | None
    weights: tuple[float, float] = (1.0, 1.0)  # of the classes 0 and 1
    tol: float = 1e-5
    before: tuple | None = None
    done: bool = False
    close: bool = False  # its loss has no corners, so that every step needs all rows

    def sums(self, x, t):
        f, w = x @ self.b, np.where(t > 0, self.weights[1], self.weights[0])
        p = 0.5 * (1 + np.tanh(f / 2))
        curve = w * p * (1 - p)
        products = ((x * curve[:, None]).T @ x)[np.triu_indices(x.shape[1])]
        return np.concatenate([products, x.T @ (w * (t - p)), [(w * (np.logaddexp(0.0, f) - t * f)).sum()]])

    def advance(self, sums: np.ndarray) -> None:
        q = len(self.b)
        tail = q * (q + 1) // 2
        h = np.zeros((q, q))
        h[np.triu_indices(q)] = sums[:tail]
        h = h + np.triu(h, 1).T
        scale, shrink = (1.0, 0.0) if self.C is None else (self.C, 1.0)
        held = np.concatenate([[0.0], self.b[1:]]) * shrink
        value = scale * sums[-1] + held @ held / 2
        if self.before is not None and value > self.before[1] + 1e-12 * abs(self.before[1]):
            start, old = self.before
            step = (self.b - start) / 2
            # A step too short to be told from none ends the search where it began.
            self.b, self.done = (start, True) if np.abs(step).max() <= 1e-12 * (1 + np.abs(start).max()) else (start + step, False)
            return
        slope = scale * sums[tail : tail + q] - held
        floor = np.diag([1e-12 + 1e-10 * scale * h[0, 0]] + [shrink + (1 - shrink) * 1e-12] * (q - 1))
        step = np.linalg.solve(scale * h + floor, slope)
        self.done = slope @ step <= self.tol**2 * max(float(self.b[1:] @ self.b[1:]), 1e-12)
        self.before, self.b = (self.b, value), self.b + step


def new_fit(name: str, p: int, n0: float, n1: float, params: dict, tol: float | None = None):
    """The start of one fit on n0 rows of class 0 and n1 of class 1. Rows of one class give a constant score."""
    s = {**DEFAULTS[name], **params}
    b = np.zeros(p + 1)
    if not n0 or not n1:
        b[0] = ONE_CLASS[name] if n1 else -ONE_CLASS[name]
        return LogisticFit(b, 1.0, done=True)
    if name == "logistic":
        balanced = s.get("class_weight") == "balanced"
        weights = ((n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)) if balanced else (1.0, 1.0)
        return LogisticFit(b, s["C"], weights, tol or 1e-5)
    mean = (n1 - n0) / (n0 + n1)
    b[0], sd = mean, float(np.sqrt(1 - mean * mean))
    return Fit(b, sd / s["C"], s["C"], tol or 1e-4, 0.0, sd, hinge=True)


@dataclass(frozen=True)
class Member:
    """One of the fits of a group: its settings, the part of the rows it leaves out, or the balanced subset it draws."""

    name: str
    params: tuple = ()
    without: int | None = None
    draw: int | None = None


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, 0))
    return np.column_stack([np.ones(len(pdf)), x])


def fit_members(rows: DataFrame, kind: str, keys, members, part: str | None = None, draws: int = 0, seed=42, tol=None, most_passes=500) -> dict:
    """{(key, member name): [intercept, coef...]} for every group of `rows(keys, x array, y 0 or 1[, part])` and all of `members`.

    A member with `without` leaves out the rows whose `part` has that value. One with `draw` sees, of each class, as many rows
    as the smaller class of the group has: those whose slot the draw's bijection sends below that number, so no draw sorts or
    copies rows (`rows` then comes from `numbered`). Class weights follow the rows that the member sees. Rows with a null label
    or a null in `x` must be left out before. Fits that do not settle raise an error.
    """
    keys = list(keys)
    names = [*keys, "y", "x", *([part] if part else []), *(["_slot", "_size"] if draws else [])]
    rows = rows.select(*names)
    counts = rows.groupBy(*keys, "y", *([part] if part else [])).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p")).toPandas()
    least, fits, parts = {}, {}, {}
    for key, mine in counts.groupby(keys, sort=False):
        key = key if isinstance(key, tuple) else (key,)
        of_class = [int(mine.n[mine.y == c].sum()) for c in (0, 1)]
        least[key] = min(of_class)
        for m in members:
            seen = mine if m.without is None else mine[mine[part] != m.without]
            n0, n1 = (least[key], least[key]) if m.draw is not None else (int(seen.n[seen.y == c].sum()) for c in (0, 1))
            if m.draw is not None and not n0:
                n0, n1 = of_class  # one class alone: a constant score
            fits[key, m.name] = new_fit(kind, int(mine.p.max()), n0, n1, dict(m.params), tol)
            parts[key, m.name] = (m.without, m.draw)
    shuffles = round_keys(draws, seed, "balanced subset") if draws else None
    hinge = kind == "svm"

    def read(mine, wanted):
        x, y = _matrix(mine), mine["y"].to_numpy(dtype=float)
        t = 2 * y - 1 if hinge else y
        drawn = [d for _, d in wanted if d is not None]
        place = {d: j for j, d in enumerate(drawn)}
        chosen = np.zeros((len(mine), len(drawn)), bool)
        if drawn:
            few = least[tuple(mine[k].iloc[0] for k in keys)]
            slots, sizes = mine["_slot"].to_numpy(), mine["_size"].to_numpy()
            for c in (0, 1):
                own = y == c
                if own.any():
                    chosen[own] = donors(slots[own], int(sizes[own][0]), shuffles[:, drawn]) < few
        for without, draw in wanted:
            if draw is not None:
                some = chosen[:, place[draw]]
            elif without is not None:
                some = mine[part].to_numpy() != without
            else:
                some = slice(None)
            yield (without, draw), x[some], t[some]

    return {k: f.b for k, f in settle(rows, keys, fits, parts, read, f"classifier {kind!r}", most_passes).items()}


def numbered(rows: DataFrame, ids, keys, seed=42) -> DataFrame:
    """`rows` with the slots that draws of balanced subsets need, within each class of a group."""
    return number_rows(rows, ids, [*keys, "y"], seed, "balanced subset")


def score_rows(rows: DataFrame, kind: str, keys, coefs: dict, members, keep, part: str | None = None) -> DataFrame:
    """(keep..., member, score) for each row of the group: of the members that leave out the row's `part`, or leave out nothing where `part` is null.

    Without `part`, of all members. Scores are probabilities (logistic) or margins (svm). The coefficients travel with the tasks.
    """
    keep, keys = list(keep), list(keys)
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["member string, score double"])
    columns = list(dict.fromkeys([*keep, *keys, "x", *([part] if part else [])]))

    def scored(batches):
        for pdf in batches:
            for key, mine in pdf.groupby(keys, sort=False):
                key = key if isinstance(key, tuple) else (key,)
                x = _matrix(mine)
                for m in members:
                    if part is None:
                        some = np.ones(len(mine), bool)
                    else:
                        some = mine[part].isna().to_numpy() if m.without is None else (mine[part] == m.without).to_numpy()
                    if not some.any():
                        continue
                    f = x[some] @ coefs[key, m.name]
                    yield mine.loc[some, keep].assign(member=m.name, score=0.5 * (1 + np.tanh(f / 2)) if kind == "logistic" else f)

    return rows.select(*columns).mapInPandas(scored, schema)


def mean_scores(rows: DataFrame, kind: str, keys, coefs: dict, members, keep) -> DataFrame:
    """(keep..., score): the mean score over all members; a matrix product a batch."""
    keep, keys = list(keep), list(keys)
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["score double"])
    columns = list(dict.fromkeys([*keep, *keys, "x"]))

    def scored(batches):
        for pdf in batches:
            for key, mine in pdf.groupby(keys, sort=False):
                key = key if isinstance(key, tuple) else (key,)
                f = _matrix(mine) @ np.stack([coefs[key, m.name] for m in members], axis=1)
                yield mine[keep].assign(score=(0.5 * (1 + np.tanh(f / 2)) if kind == "logistic" else f).mean(axis=1))

    return rows.select(*columns).mapInPandas(scored, schema)


def platt_curves(scores: DataFrame, keys) -> dict:
    """{key: (intercept, slope)} of a logistic curve through the out-of-fold scores of each group; groups of one class have none.

    The penalty is |slope|^2 / 2e6, so scores that part the classes entirely give a steep curve instead of none.
    """
    rows = stage(scores.select(*keys, F.col("y").cast("int").alias("y"), F.array(F.col("score").cast("double")).alias("x")).where("score is not null"))
    both = {tuple(r[:-1]) for r in rows.groupBy(*keys).agg(F.countDistinct("y").alias("_c")).where("_c = 2").collect()}
    coefs = fit_members(rows, "logistic", keys, [Member("curve", (("C", 1e6), ("class_weight", None)))])
    return {key: tuple(float(v) for v in b) for (key, _), b in coefs.items() if key in both}
