"""Linear models from cross-product tables: one pass over the data serves every fold, model and permuted target."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Linear:
    """A linear model: least squares (alpha 0), ridge, or elastic net (l1 > 0)."""

    name: str
    alpha: float = 0.0
    l1: float = 0.0


@dataclass(frozen=True)
class Block:
    """Many targets made from a few columns within a task: `make(rows, which)` gives a matrix of one column per name, or of those numbered `which`."""

    names: list[str]
    columns: list[str]
    make: Callable[..., np.ndarray]


#: Cells of rows x products that a task holds at once.
CELLS = 1_000_000


def gram(df: DataFrame, columns, targets, keys, side: str | None = None, weight: str | None = None, block: Block | None = None) -> DataFrame:
    """(keys..., [side], i, j, value): cross products of [1, columns, targets, block] per key; targets only with themselves.

    Each task sums its own rows in numpy and emits one small triangle per key, so the shuffle carries
    tasks x keys x products, never rows. With `weight`, rows on the training side are also summed under side
    "fit" with their weight.
    """
    columns, targets, keys = list(columns), list(targets), list(keys)
    width = 1 + len(columns) + len(targets) + (len(block.names) if block else 0)
    head = 1 + len(columns)
    left, right = pair_places(head, width)
    numbers = list(dict.fromkeys([*columns, *targets, *([weight] if weight else [])]))
    more = [c for c in (block.columns if block else []) if c not in numbers]
    picked = df.select(*keys, *([side] if side else []), *[F.col(c).cast("double").alias(c) for c in numbers], *more)
    picked = picked.dropna("any", subset=columns)
    kinds = dict(picked.dtypes)
    out_keys = [*keys, *(["side"] if side else [])]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + (["side string"] if side else []) + ["i int, j int, value double"])

    def partial(batches):
        sums: dict = {}

        def add(key, rows, w=None):
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                part = rows.iloc[at : at + step]
                x = np.column_stack([np.ones(len(part)), part[columns + targets].to_numpy(dtype=float), *([block.make(part)] if block else [])])
                wx = x if w is None else x * w[at : at + step, None]
                sums[key] = sums.get(key, 0.0) + _products(wx, x, left, right, head)

        for pdf in batches:
            by = out_keys[: len(keys)] + ([side] if side else [])
            parts = pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]
            for key, rows in parts:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                if side:
                    train = bool(key[-1])
                    add((*key[:-1], "train" if train else "test"), rows)
                    if weight and train:
                        add((*key[:-1], "fit"), rows, rows[weight].to_numpy(dtype=float))
                else:
                    add(key, rows, rows[weight].to_numpy(dtype=float) if weight else None)
        for key, block_sums in sums.items():
            frame = pd.DataFrame({"i": left.astype("int32"), "j": right.astype("int32"), "value": block_sums})
            for name, value in zip(out_keys, key):
                frame[name] = value
            yield frame[[*out_keys, "i", "j", "value"]]

    return picked.mapInPandas(partial, schema).groupBy(*out_keys, "i", "j").agg(F.sum("value").alias("value"))


def member_gram(df: DataFrame, columns, target: str, keys, deal: Callable, more=()) -> DataFrame:
    """(keys..., member, v0, v1, ...): for many sets of rows the cross products of [1, columns] with [1, columns, target], and the target's square.

    `deal(batches)` yields rows of the batches with a matrix (rows x sets) that is 1 where a row belongs to a set; it sees the columns `more` too.
    A task emits one row per key and set, whatever its rows; none is copied for a set. The order of the products is that of `pair_places`.
    """
    columns, keys = list(columns), list(keys)
    left, right = pair_places(1 + len(columns), 2 + len(columns))
    names = [f"v{i}" for i in range(len(left))]
    extra = [c for c in more if c not in {*keys, *columns, target}]
    picked = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in [*columns, target]], *extra).dropna("any", subset=[*columns, target])
    kinds = dict(picked.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["member int"] + [f"{v} double" for v in names])

    def partial(batches):
        sums: dict = {}
        for rows, member in deal(batches):
            x = np.column_stack([np.ones(len(rows)), rows[[*columns, target]].to_numpy(dtype=float)])
            products = x[:, left] * x[:, right]
            for key, at in rows.groupby(keys, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums.get(key, 0.0) + member[at].T @ products[at]
        for key, block in sums.items():
            out = pd.DataFrame(block, columns=names)
            out.insert(0, "member", np.arange(len(block), dtype="int32"))
            for name, value in zip(keys, key):
                out[name] = value
            yield out[[*keys, "member", *names]]

    return picked.mapInPandas(partial, schema).groupBy(*keys, "member").agg(*[F.sum(v).alias(v) for v in names])


def pair_places(head: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which two of [1, columns, targets] each product is of: all pairs with the first `head`, and the others with themselves."""
    pairs = [(i, j) for i in range(head) for j in range(i, width)] + [(j, j) for j in range(head, width)]
    return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])


def _products(wx, x, left, right, head):
    full = wx[:, :head].T @ x
    tail = (wx[:, head:] * x[:, head:]).sum(axis=0)
    return np.concatenate([full[left[left < head], right[left < head]], tail])


@dataclass
class Moments:
    """Sums over some rows: `xx` of products of [1, columns], `xy` of these with targets, `yy` of squared targets."""

    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    @staticmethod
    def read(pdf: pd.DataFrame, head: int, width: int) -> Moments:
        out = Moments(np.zeros((head, head)), np.zeros((head, width - head)), np.zeros(width - head))
        i, j, v = pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["value"].to_numpy()
        own, cross = j < head, (i < head) & (j >= head)
        out.xx[i[own], j[own]] = v[own]
        out.xx[j[own], i[own]] = v[own]
        out.xy[i[cross], j[cross] - head] = v[cross]
        out.yy[j[i >= head] - head] = v[i >= head]
        return out

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.xx - other.xx, self.xy - other.xy, self.yy - other.yy)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.xx + other.xx, self.xy + other.xy, self.yy + other.yy)

    def mapped(self, terms: np.ndarray) -> Moments:
        """The same sums for the columns `terms` @ [1, columns]."""
        return Moments(terms @ self.xx @ terms.T, terms @ self.xy, self.yy)

    def less(self, cov: list[int], terms: np.ndarray) -> Moments:
        """The same sums for targets less `terms` (covariates x targets) times the columns `cov`."""
        yy = self.yy - 2 * (terms * self.xy[cov]).sum(axis=0) + (terms * (self.xx[np.ix_(cov, cov)] @ terms)).sum(axis=0)
        return Moments(self.xx, self.xy - self.xx[:, cov] @ terms, yy)


class Solver:
    """Linear models on some columns of one set of moments, all targets at once; the intercept is not penalised.

    The eigendecomposition of the centred products serves every ridge penalty, and the elastic net starts each time from where
    it ended last.
    """

    def __init__(self, moments: Moments, columns: list[int], steps=20_000, tol=1e-9):
        self.n, self.steps, self.tol = moments.xx[0, 0], steps, tol
        self.mean_x, self.mean_y = moments.xx[0, columns] / self.n, moments.xy[0] / self.n
        self.s = moments.xx[np.ix_(columns, columns)] - self.n * np.outer(self.mean_x, self.mean_x)
        self.b = moments.xy[columns] - self.n * np.outer(self.mean_x, self.mean_y)
        self.spectrum = None
        self.last = np.zeros_like(self.b)

    def solve(self, model: Linear) -> np.ndarray:
        """(1 + columns) x targets: intercept and coefficients."""
        if model.l1:
            beta = self.last = self._elastic(model)
        elif model.alpha:
            if self.spectrum is None:
                self.spectrum = np.linalg.eigh(self.s)
            values, vectors = self.spectrum
            beta = vectors @ ((vectors.T @ self.b) / (np.maximum(values, 0.0) + model.alpha)[:, None])
        else:
            beta = np.linalg.lstsq(self.s, self.b, rcond=None)[0]
        return np.vstack([self.mean_y - self.mean_x @ beta, beta])

    def _elastic(self, model: Linear) -> np.ndarray:
        s, b, beta, thin = self.s / self.n, self.b / self.n, self.last.copy(), model.alpha * model.l1
        for _ in range(self.steps):
            biggest = 0.0
            for g in range(len(s)):
                if s[g, g] <= 0:
                    continue
                partial = b[g] - s[g] @ beta + s[g, g] * beta[g]
                new = np.sign(partial) * np.maximum(np.abs(partial) - thin, 0.0) / (s[g, g] + model.alpha * (1 - model.l1))
                biggest, beta[g] = max(biggest, float(np.abs(new - beta[g]).max(initial=0.0))), new
            if biggest < self.tol:
                return beta
        raise RuntimeError(f"{model.name} did not settle after {self.steps} sweeps")


FIT_SCHEMA = (
    "run int, model string, target string, coef array<double>, resid array<double>, n double, sp double, spp double, "
    "sy double, syy double, spy double, y_mean double, y_sd double, resid_r2 double"
)


def residualizer(train: Moments, cov: list[int]) -> np.ndarray:
    """Least squares of the targets on the columns `cov`, one column a target; zero where `cov` is the intercept alone."""
    if len(cov) == 1:
        return np.zeros((1, train.xy.shape[1]))
    return np.linalg.lstsq(train.xx[np.ix_(cov, cov)], train.xy[cov], rcond=None)[0]


def held_out_sums(held: Moments, columns: list[int], beta: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over held-out rows from which r, r2 and mse follow, one value a target."""
    xb = held.xx[np.ix_(columns, columns)] @ beta
    return {"n": np.full(beta.shape[1], held.xx[0, 0]), "sp": xb[0], "spp": (beta * xb).sum(axis=0), "sy": held.xy[0], "syy": held.yy, "spy": (beta * held.xy[columns]).sum(axis=0)}


def run_table(df: DataFrame, features, covariates, targets, groups=(), weight=None, block: Block | None = None, part: str | None = None) -> DataFrame:
    """The cross products that `solve_runs` takes, by (groups, run, [part], side)."""
    complete_rows = df.dropna("any", subset=[*features, *covariates, *targets, *(block.columns if block else [])])
    return gram(complete_rows, [*features, *covariates], targets, [*groups, "run", *([part] if part else [])], "is_train", weight, block)


def fit_runs(df: DataFrame, features, covariates, targets, models, groups=(), weight=None, residualize=True, drop_each=False, block: Block | None = None) -> DataFrame:
    """Fit every (group, run, model, target) and score it on the run's held-out rows.

    `df` holds each row once per run with `is_train`. Returns coefficient arrays over [1, features], the
    residualizer over [1, covariates], and the held-out sums (n, pred, pred^2, y, y^2, pred*y) from which pooled
    r, r2, mse follow for any number of targets without touching the data again. `drop_each` adds, per feature,
    the fit without it. `block` adds targets that are made within the tasks.
    """
    table = run_table(df, features, covariates, targets, groups, weight, block)
    return solve_runs(table, features, covariates, [*targets, *(block.names if block else [])], models, groups, residualize, drop_each)


def solve_runs(table: DataFrame, features, covariates, targets, models, groups=(), residualize=True, drop_each=False) -> DataFrame:
    """`fit_runs` from its table of cross products."""
    features, covariates, targets, groups = list(features), list(covariates), list(targets), list(groups)
    kinds = dict(table.dtypes)
    schema = ", ".join([f"`{g}` {kinds[g]}" for g in groups] + [FIT_SCHEMA])
    names = [*groups, *[c.split()[0] for c in FIT_SCHEMA.split(", ")]]
    p, q, m = len(features), len(covariates), len(targets)
    head, width = 1 + p + q, 1 + p + q + m
    variants = [(list(range(p)), "")]
    if drop_each:
        variants += [([g for g in range(p) if g != d], f"-without-{features[d]}") for d in range(p)]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = {s: Moments.read(part, head, width) for s, part in pdf.groupby("side")}
        key = [pdf[g].iloc[0] for g in groups] + [int(pdf["run"].iloc[0])]
        if "train" not in sides or "test" not in sides:
            return pd.DataFrame(columns=names)
        cov = [0, *range(1 + p, head)] if residualize and q else [0]
        terms = residualizer(sides["train"], cov)
        train, test, fit = (sides.get(s, sides["train"]).less(cov, terms) for s in ("train", "test", "fit"))
        n_train = train.xx[0, 0]
        y_mean = train.xy[0] / n_train
        y_sd = np.sqrt(np.maximum(train.yy / n_train - y_mean**2, 0.0))
        raw_var = sides["train"].yy - sides["train"].xy[0] ** 2 / n_train
        r2 = np.where(raw_var > 0, 1 - (train.yy - train.xy[0] ** 2 / n_train) / np.where(raw_var > 0, raw_var, 1.0), 0.0)
        parts = []
        for keep, suffix in variants:
            columns = [1 + g for g in keep]
            solver = Solver(fit, columns)
            for model in models:
                beta = np.zeros((1 + p, m))
                beta[[0, *columns]] = solver.solve(model)
                sums = held_out_sums(test, list(range(1 + p)), beta)
                parts.append(pd.DataFrame({
                    "model": model.name + suffix, "target": targets, "coef": list(beta.T), "resid": list(terms.T), **sums, "y_mean": y_mean, "y_sd": y_sd, "resid_r2": r2,
                }))
        out = pd.concat(parts, ignore_index=True)
        for name, value in zip([*groups, "run"], key):
            out[name] = value
        return out[names]

    # One group is one model run: (sides x products) numbers.
    return table.groupBy(*groups, "run").applyInPandas(solve, schema)


def pooled_r(fits: DataFrame, groups=()) -> DataFrame:
    """(groups..., model, target, pearson_r, r2, mse, n) over all held-out rows, from the sums alone."""
    sums = ["n", "sp", "spp", "sy", "syy", "spy"]
    t = fits.groupBy(*groups, "model", "target").agg(*[F.sum(c).alias(c) for c in sums])
    c = F.col
    vp, vy = c("spp") - c("sp") * c("sp") / c("n"), c("syy") - c("sy") * c("sy") / c("n")
    cov, sse = c("spy") - c("sp") * c("sy") / c("n"), c("syy") - 2 * c("spy") + c("spp")
    flat = (vp / c("n") < 1e-20) | (vy / c("n") < 1e-20)
    return t.select(
        *groups, "model", "target", F.when(flat, F.lit(0.0)).otherwise(F.try_divide(cov, F.sqrt(vp * vy))).alias("pearson_r"),
        F.when(flat, F.lit(0.0)).otherwise(1 - F.try_divide(sse, vy)).alias("r2"), (sse / c("n")).alias("mse"), c("n").cast("long").alias("n"),
    )


def coefficients(fits: DataFrame, features, groups=()) -> DataFrame:
    """(groups..., run, model, target, feature, value)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.get("coef", F.lit(i + 1)).alias("value")) for i, f in enumerate(features)])
    return fits.withColumn("_c", F.explode(pairs)).select(*groups, "run", "model", "target", "_c.feature", "_c.value")


def residual_terms(fits: DataFrame, covariates) -> DataFrame:
    """(fold, term, value) of the residualizer, with its r2."""
    names = ["intercept", *covariates]
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.get("resid", F.lit(i)).alias("value")) for i, t in enumerate(names)], F.struct(F.lit("r2").alias("term"), F.col("resid_r2").alias("value")))
    one = fits.groupBy("run").agg(F.first("resid").alias("resid"), F.first("resid_r2").alias("resid_r2"))
    return one.withColumn("_c", F.explode(pairs)).select(F.col("run").alias("fold"), "_c.term", "_c.value")


def linear_value(array: str, cols):
    """intercept + array . columns."""
    out = F.get(array, F.lit(0))
    for i, c in enumerate(cols):
        out = out + F.get(array, F.lit(i + 1)) * F.col(c)
    return out
