"""Linear epsilon-insensitive and hinge losses by Newton steps on a smoothed loss, all groups in one pass per step.

Passes over all rows are needed only until the rows that may still change sides are few (`NEAR_ROWS`): the loss of the others is a line
there, so the last steps of a fit run over the few rows and the others' sums, within one task, under the gap of all rows.
Fits over many rows begin at the fit of some thousands of them (`START_ROWS`), with little smoothing, which leaves a few passes over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.models.grouped import settle
from varve.session import stage, stage_small

_HALVINGS = 0.5 ** np.arange(1, 31)
#: Rows of one fit that may still bend its loss when a single task takes them over.
NEAR_ROWS = 4096
#: Rows of one support vector regression over which its start is fitted, and that a single task takes over at its end.
START_ROWS = 16_384
_MOST_CENTRES = 4


def _limits(t, C, hinge):
    """Least and greatest dual value of each row; with the hinge loss, rows of either class (t = -1 or 1) pull to their own side only."""
    return (np.minimum(C * t, 0.0), np.maximum(C * t, 0.0)) if hinge else (-C, C)


def _pull(r, epsilon, mu, limits, held):
    """The dual value of each row, which is also the slope of its smoothed loss: the best one near the value `held` of the level before."""
    v = held + r / mu
    return np.clip(np.sign(v) * np.maximum(np.abs(v) - epsilon / mu, 0.0), *limits)


def _loss(r, a, epsilon, mu, held):
    return a * r - epsilon * np.abs(a) - mu / 2 * (a - held) ** 2


def _held(x, t, levels, epsilon, limits):
    """Dual values after the settled levels [(fit, mu)], worked out anew from the row: nothing is stored with it."""
    a = np.zeros(len(t))
    at = np.stack([b for b, _ in levels]) @ x.T if levels else ()
    for f, (_, mu) in zip(at, levels):
        a = _pull(t - f, epsilon, mu, limits, a)
    return a


def row_sums(x, t, levels, b, mu, epsilon, C, hinge=False) -> np.ndarray:
    """What one step needs of rows x (first column 1) with targets t at fit b, as one vector of sums.

    The triangle of x'x over rows whose dual value is free, x weighted by what these values have moved in this level, x
    weighted by the dual values, the smoothed loss, the rows' share of the duality gap, the number of rows within mu * C of a
    corner of the loss, and that of all rows.
    """
    low, high = limits = _limits(t, C, hinge)
    held, r = _held(x, t, levels, epsilon, limits), t - x @ b
    a = _pull(r, epsilon, mu, limits, held)
    free = (a != 0) & (a > low) & (a < high)
    # So written, the gap of a row whose dual value is at its limit is exactly 0, however many such rows are added up.
    gap = np.maximum(np.maximum(high * (r - epsilon), low * (r + epsilon)), 0.0) - np.abs(a) * (np.sign(a) * r - epsilon)
    products = (x[free].T @ x[free])[np.triu_indices(x.shape[1])]
    near = np.count_nonzero(np.abs(np.abs(r) - epsilon) <= mu * C)
    return np.concatenate([products, x[free].T @ (a - held)[free], x.T @ a, [_loss(r, a, epsilon, mu, held).sum(), gap.sum(), near, len(t)]])


def search_sums(x, t, levels, b, way, mu, epsilon, C, hinge=False) -> np.ndarray:
    """The smoothed loss at b + s * way for every halved step s."""
    limits = _limits(t, C, hinge)
    held, r, move = _held(x, t, levels, epsilon, limits), t - x @ b, x @ way
    out = []
    for s in _HALVINGS:
        a = _pull(r - s * move, epsilon, mu, limits, held)
        out.append(_loss(r - s * move, a, epsilon, mu, held).sum())
    return np.array(out)


@dataclass
class Fit:
    """Where the fit of one group stands."""

    b: np.ndarray
    mu: float
    C: float
    tol: float
    epsilon: float = 0.1
    reach: float = float("inf")  # the intercept's longest step
    levels: list = field(default_factory=list)
    passes: int = 0  # in this level
    before: tuple | None = None  # the last point of this level, its objective and, in a search, the step
    searching: bool = False
    done: bool = False
    hinge: bool = False  # classes -1 and 1, epsilon 0: the loss is C * max(1 - t * f, 0)
    most_near: int = NEAR_ROWS
    centre: np.ndarray | None = None  # where the rows near a corner are to be taken from, if they are few
    width: float = 0.0  # how near
    centres: int = 0  # tried from this level on

    @property
    def close(self) -> bool:
        return self.centre is not None

    def sums(self, x, t):
        if self.searching:
            return search_sums(x, t, self.levels, self.before[0], self.before[2], self.mu, self.epsilon, self.C, self.hinge)
        return row_sums(x, t, self.levels, self.b, self.mu, self.epsilon, self.C, self.hinge)

    def advance(self, sums: np.ndarray) -> None:
        """Use the sums at the current point: end, halve a step that failed, or take the next one."""
        self.passes += 1
        if self.searching:
            start, _, way = self.before
            tried = [(start + s * way)[1:] @ (start + s * way)[1:] / 2 + v for s, v in zip(_HALVINGS, sums)]
            self.b, self.searching, self.before = start + _HALVINGS[int(np.argmin(tried))] * way, False, None
            return
        q = len(self.b)
        a, tail = np.zeros((q, q)), q * (q + 1) // 2
        a[np.triu_indices(q)] = sums[:tail]
        a = a + np.triu(a, 1).T
        moved, pull = sums[tail : tail + q], sums[tail + q : tail + 2 * q]
        loss, rows_gap, near, rows = sums[-4:]
        value = self.b[1:] @ self.b[1:] / 2 + loss
        if self.before is not None and value > self.before[1] + 1e-12 * abs(self.before[1]):
            start, old, _ = self.before
            self.before, self.searching = (start, old, self.b - start), True
            return
        # |b - sum of pulls|^2 / 2 + the rows' share bounds how far the objective is above its least value, once the dual values sum to 0.
        off = pull - np.concatenate([[0.0], self.b[1:]])
        still = off[1:] @ off[1:] / 2
        # Margins of the hinge loss are told from 1, and its best coefficients may all be 0: their error is then bounded as such.
        goal = self.tol**2 * max(float(self.b[1:] @ self.b[1:]), 1.0 if self.hinge else 1e-12) / 2
        level = abs(off[0]) <= 1e-5 * self.C
        if level and still + rows_gap <= goal:
            self.done = True
            return
        settled, width = still <= max(3 * rows_gap, 0.1 * goal), self.mu * self.C
        if settled:
            self.levels.append((self.b, self.mu))
            shrink = 0.5 if self.passes <= 5 else 1.0
            off, self.mu, self.passes = off + moved / shrink, self.mu * shrink, 0
        # With few free rows or none the intercept would be thrown far beyond the data.
        hold = np.diag([max(1e-10 * max(a[0, 0], 1.0) / self.mu, abs(off[0]) / self.reach - a[0, 0] / self.mu)] + [1.0] * (q - 1))
        self.before = None if settled else (self.b, value, None)
        self.b = self.b + np.linalg.solve(hold + a / self.mu, off)
        if near <= self.most_near:
            self.centre, self.width, self.centres = self.b, float("inf") if rows <= self.most_near else width, 0

    def split(self, x, t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What rows add around the centre: sums of those further than `width` from each corner, greatest |x|, and the near rows (x, t).

        A far row stays on its side as long as its residual moves by less than `width`: its loss is a line with the dual value as slope.
        """
        low, high = _limits(t, self.C, self.hinge)
        r = t - x @ self.centre
        far = np.abs(np.abs(r) - self.epsilon) > self.width
        a = np.where(r > self.epsilon, high, np.where(r < -self.epsilon, low, 0.0)) * far
        return np.append(x.T @ a, a @ t - self.epsilon * np.abs(a).sum()), np.abs(x).max(axis=0), np.column_stack([x, t])[~far]

    def finish(self, lines: np.ndarray, top: np.ndarray, near: np.ndarray, most_steps=500) -> tuple[np.ndarray | None, float]:
        """The optimum with the far rows' loss as a line, and how far it may move a residual. Up to `width` it is that of all rows, with its gap."""
        x, t, slope = near[:, :-1], near[:, -1], lines[:-1]
        fit = Fit(self.centre, self.mu, self.C, self.tol, self.epsilon, self.reach, hinge=self.hinge)
        q = len(slope)
        for _ in range(most_steps):
            sums = fit.sums(x, t)
            if fit.searching:
                sums = sums + lines[-1] - fit.before[0] @ slope - _HALVINGS * (fit.before[2] @ slope)
            else:
                sums[-4 - q : -4] += slope
                sums[-4] += lines[-1] - fit.b @ slope
            fit.advance(sums)
            if fit.done:
                return fit.b, float(top @ np.abs(fit.b - self.centre))
        return None, float("inf")

    def move(self, b: np.ndarray | None, reached: float) -> None:
        """Use what `finish` found (None: too many near rows, or no end): the end, a centre nearer to it, or more steps over all rows."""
        self.centres += 1
        if b is not None and reached <= self.width:
            self.b, self.done = b, True
        elif b is not None and reached <= 16 * self.width and self.centres < _MOST_CENTRES:
            self.centre = b
        else:
            self.centre, self.most_near = None, self.most_near // 4


@dataclass(frozen=True)
class Variant:
    """One of several fits on the rows of a group: its settings, the part of the rows and the feature (from 1) that it leaves out."""

    name: str
    C: float = 1.0
    epsilon: float = 0.1
    without: int | None = None
    blank: int | None = None


def fit_svr(train: DataFrame, features, y: str, keys, C=1.0, epsilon=0.1, tol=1e-4, most_passes=500) -> dict:
    """{key: [intercept, coef...]} minimising |beta|^2/2 + C * sum(max(|y - f| - epsilon, 0)) per key."""
    found = fit_svr_variants(train, features, y, keys, lambda key: [Variant("", C, epsilon)], tol=tol, most_passes=most_passes)
    return {key: b for (key, _), b in found.items()}


def fit_svr_variants(train: DataFrame, features, y: str, keys, variants, part: str | None = None, tol=1e-4, most_passes=500) -> dict:
    """{(key, variant name): [intercept, coef...]}: for each key all fits that `variants(key)` lists, over the same rows.

    Proximal steps on the dual round the corners of the loss; each is solved by Newton steps, one cross-product aggregate over
    the data and a p x p solve each. A step that raises the objective is halved. A fit ends when its duality gap proves its
    coefficients within `tol` times their length of the optimum. Fits that have not ended after `most_passes` raise an error.
    Once only few rows are near a corner of the loss, these and the sums of all others go to one task, which ends the fit.
    A variant with `without` leaves out the rows whose column `part` has that value, one with `blank` takes that feature as zero; rows are
    never copied for a variant. Groups of more than four times `START_ROWS` begin at the fits over about `START_ROWS` of their rows, drawn at random
    by a fixed seed: that changes the passes that are needed, while the end is proven by the gap over all rows.
    Only (fits x p^2) numbers reach the driver. `train` is read once per step: stage or cache it.
    """
    features, keys = list(features), list(keys)
    p = len(features)
    rows = train.select(*keys, *([part] if part else []), *[F.col(c).cast("double").alias(c) for c in [*features, y]]).dropna("any", subset=[*features, y])
    known = stage_small(rows.groupBy(*keys).agg(F.avg(y).alias("_mean"), F.stddev_pop(y).alias("_sd"), F.count(F.lit(1)).alias("_n")))
    fits: dict = {}
    starts: dict = {}
    parts: dict = {}
    for *key, mean, sd, n in known.toPandas()[[*keys, "_mean", "_sd", "_n"]].itertuples(index=False, name=None):
        many, sd = n > 4 * START_ROWS, max(sd, 1e-6)
        for v in variants(tuple(key)):
            flat, at = np.concatenate([[mean], np.zeros(p)]), (tuple(key), v.name)
            # So smoothed, about twice as many rows are near a corner as the last steps take.
            fits[at] = Fit(flat, sd / v.C * (START_ROWS / n if many else 1.0), v.C, tol, v.epsilon, sd, most_near=START_ROWS)
            parts[at] = (v.without, v.blank)
            if many:
                C = v.C * n / START_ROWS
                starts[at] = Fit(flat, sd / C, C, tol, v.epsilon, sd, most_near=2 * START_ROWS)

    def read(mine, parts):
        used: dict = {}
        for without, blank in parts:
            if without not in used:
                kept = mine if without is None else mine[mine[part] != without]
                used[without] = np.column_stack([np.ones(len(kept)), kept[features].to_numpy(dtype=float)]), kept[y].to_numpy(dtype=float)
            x, t = used[without]
            if blank is not None:
                x = x.copy()
                x[:, blank] = 0.0
            yield (without, blank), x, t

    what = "support vector regression"
    if starts:
        some = rows.join(known.where(F.col("_n") > 4 * START_ROWS).select(*keys, "_n"), keys).where(F.rand(7) * F.col("_n") < START_ROWS).drop("_n")
        for at, fit in settle(stage(some), keys, starts, parts, read, what, most_passes=50, must=False).items():
            fits[at].b = fit.b
    return {k: f.b for k, f in settle(rows, keys, fits, parts, read, what, most_passes).items()}


def svr_table(spark, beta: dict, keys, kinds: dict) -> DataFrame:
    """The fitted coefficients as a table: (keys..., svr array)."""
    rows = [(*[k.item() if hasattr(k, "item") else k for k in key], [float(v) for v in b]) for key, b in beta.items()]
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["svr array<double>"])
    return spark.createDataFrame(rows, schema)
