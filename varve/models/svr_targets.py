"""Linear epsilon-insensitive regressions of many targets over the same rows, as a permuted study needs them.

No row is copied for a target. A task makes all targets of some rows as a matrix (`gram.Block`), once for all runs the rows are in, and
works on rows x targets at a time. Newton steps on a smoothed loss, over some of the rows first, bring every fit near its end; then the loss
of a row far from its corners is a line, so the few rows near one and the others' sums end the fit in one task (`svr.Fit.finish`), under the gap of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.models.gram import Block, Moments, residualizer
from varve.models.grouped import settle
from varve.models.svr import START_ROWS, Fit
from varve.operators.prep import complete
from varve.session import stage

#: Cells of rows x targets that a task works on at once.
CELLS = 250_000
#: About so many rows near a corner end a fit; up to twice as many are taken over by a task.
NEAR = 4096
#: Numbers of near rows that a task holds before it passes them on.
HELD = 8_000_000
#: Widths of the smoothed loss, in standard deviations, over the first rows; one Newton step each.
WIDTHS = (1.0, 0.5, 0.25, 0.12)
#: Rows within the width of a corner in the steps over more rows.
WITHIN = 8192
_MOST_CENTRES, _PART = 8, 128


@dataclass(frozen=True)
class Study:
    """What the rows of all targets share: `rows` has keys, is_train, features, covariates, the target, the block's columns and `place`.

    Rows of one `place` have the same targets.
    """

    rows: DataFrame
    keys: tuple[str, ...]
    features: tuple[str, ...]
    covariates: tuple[str, ...]
    target: str
    block: Block
    place: str
    C: float = 1.0
    epsilon: float = 0.1
    tol: float = 1e-4

    @property
    def names(self) -> list[str]:
        return [self.target, *self.block.names]

    @property
    def schema(self) -> str:
        kinds = dict(self.rows.dtypes)
        return ", ".join(f"`{k}` {kinds[k]}" for k in self.keys)

    def pieces(self, which=None):
        """How a task reads its rows: (key, rows x [1, features, covariates], rows x targets), some at a time; of the targets only those numbered `which`, if given."""
        keys, columns, target, block, place = list(self.keys), [*self.features, *self.covariates], self.target, self.block, self.place
        which = np.arange(len(self.names)) if which is None else np.asarray(which)
        real, made, step = which == 0, which[which > 0] - 1, max(1, CELLS // len(which))

        def read(pdf: pd.DataFrame):
            _, first, places = np.unique(pdf[place].to_numpy(), return_index=True, return_inverse=True)
            order = np.argsort(places, kind="stable")
            ends = np.searchsorted(places[order], np.arange(0, len(first) + step, step))
            for at, (low, high) in enumerate(zip(ends[:-1], ends[1:])):
                own = first[at * step : (at + 1) * step]
                some = pdf.iloc[own]
                targets = np.empty((len(some), len(which)))
                targets[:, real] = some[target].to_numpy(dtype=float)[:, None]
                targets[:, ~real] = block.make(some, made)
                part = pdf.iloc[order[low:high]]
                own = places[order[low:high]] - at * step
                base = np.column_stack([np.ones(len(part)), part[columns].to_numpy(dtype=float)])
                for key, mine in part.groupby(keys, sort=False).indices.items():
                    yield (key if isinstance(key, tuple) else (key,)), base[mine], targets[own[mine]]

        return read


def _sums(study: Study, rows: DataFrame, work, state: dict | None = None) -> dict:
    """{key: (sums x targets, further sums)}, where `work(base, targets, state of the key)` gives both for some rows of a key."""
    read, keys, m = study.pieces(), list(study.keys), len(study.names)
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def partial(batches):
        known, sums = shared.value, {}
        for pdf in batches:
            for key, base, targets in read(pdf):
                if known is None or key in known:
                    wide, rest = work(base, targets, known and known[key])
                    if key in sums:
                        sums[key][0][:] += wide
                        sums[key][1][:] += rest
                    else:
                        sums[key] = wide, rest
        for key, (wide, rest) in sums.items():
            parts = [wide[:, at : at + _PART].ravel() for at in range(0, m, _PART)]
            yield pd.DataFrame([[*key, i - 1, v] for i, v in enumerate([rest, *parts])], columns=[*keys, "part", "v"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(v=[np.sum(list(pdf["v"]), axis=0)])

    schema = f"{study.schema}, part int, v array<double>"
    summed = rows.mapInPandas(partial, schema).groupBy(*keys, "part").applyInPandas(total, schema)
    out = {}
    # (keys x sums x targets) numbers.
    for key, mine in summed.toPandas().groupby(keys, sort=False):
        by = {p: np.array(v, dtype=float) for p, v in zip(mine["part"], mine["v"])}
        wide = [by[i].reshape(-1, min(_PART, m - i * _PART)) for i in range(len(by) - 1)]
        out[key if isinstance(key, tuple) else (key,)] = np.hstack(wide), by[-1]
    shared.destroy()
    return out


def _moments(base, targets, _):
    return np.vstack([base.T @ targets, np.einsum("ij,ij->j", targets, targets)]), (base.T @ base).ravel()


def scale_targets(study: Study, sums: dict) -> dict:
    """{key: state}: the residualizer's terms, means and deviations of all targets, and `b`, their least squares on the features."""
    p, out = len(study.features), {}
    head = 1 + p + len(study.covariates)
    cov = [0, *range(1 + p, head)] if study.covariates else [0]
    for key, (wide, rest) in sums.items():
        raw = Moments(rest.reshape(head, head), wide[:-1], wide[-1])
        terms = residualizer(raw, cov)
        left, n = raw.less(cov, terms), raw.xx[0, 0]
        mean = left.xy[0] / n
        sd = np.sqrt(np.maximum(left.yy / n - mean**2, 0.0))
        sd = np.where(sd > 0, sd, 1.0)
        own = list(range(1 + p))
        b = np.linalg.lstsq(left.xx[np.ix_(own, own)], left.xy[own], rcond=None)[0]
        b[0] -= mean
        flat = np.zeros((head, len(mean)))
        flat[cov] = terms
        flat[0] += mean
        out[key] = {"n": n, "mean": mean, "sd": sd, "resid": flat, "b": b / sd}
    return out


def _residuals(base, targets, s, p):
    """Scaled targets less their fits."""
    terms = s["resid"] / s["sd"]
    terms[: 1 + p] += s["b"]
    r = targets * (1.0 / s["sd"])
    r -= base @ terms
    return r


def _newton(p: int, epsilon: float):
    left, right = np.triu_indices(1 + p)

    def work(base, targets, s):
        x, h = base[:, : 1 + p], s["h"]
        r = _residuals(base, targets, s, p)
        up, down = np.clip((r - epsilon) / h, -1.0, 1.0), np.clip((r + epsilon) / h, -1.0, 1.0)
        free = (np.abs(up) < 1.0).astype(float) + (np.abs(down) < 1.0)
        up += down
        return np.vstack([x.T @ up / 2, (x[:, left] * x[:, right]).T @ free]), np.array([float(len(x))])

    return work


def _step(study: Study, rows: DataFrame, state: dict, width) -> None:
    """One Newton step of all fits on the loss smoothed within `width(state)` of its corners, over `rows`; `k` counts the rows within."""
    p = len(study.features)
    q = 1 + p
    for s in state.values():
        s["h"] = width(s)
    sums = _sums(study, rows, _newton(p, study.epsilon), state)
    left, right = np.triu_indices(q)
    for key, s in state.items():
        if key not in sums:
            continue
        wide, (seen,) = sums[key]
        weight = study.C * s["n"] / seen
        h = np.broadcast_to(s["h"], wide.shape[1:])
        a = np.zeros((wide.shape[1], q, q))
        a[:, left, right] = wide[q:].T
        a[:, right, left] = wide[q:].T
        a *= (weight / (2 * h))[:, None, None]
        # Where the loss is a line the intercept is held; a step is never longer than the data are wide.
        a[:, range(q), range(q)] += np.array([1e-6 * study.C] + [1.0] * p)
        way = weight * wide[:q].T
        way[:, 1:] -= s["b"][1:].T
        way = np.linalg.solve(a, way[:, :, None])[:, :, 0]
        s["b"] = s["b"] + (way / np.maximum(np.abs(way).max(axis=1, keepdims=True), 1.0)).T
        s["k"] = np.maximum(wide[q] * s["n"] / seen, 1.0)


def _last_rows(study: Study, rows: DataFrame, state: dict) -> pd.DataFrame:
    """(keys..., fit, b, reached): `Fit.finish` of the fits that are open, from rows within their width `w` of a corner and the others' sums."""
    p, C, epsilon, tol = len(study.features), study.C, study.epsilon, study.tol
    which = np.flatnonzero(np.any([s["open"] for s in state.values()], axis=0))
    read, keys = study.pieces(which), list(study.keys)
    shared = rows.sparkSession.sparkContext.broadcast({key: {c: s[c][..., which] for c in ("resid", "sd", "b", "w", "open")} for key, s in state.items()})

    def out_rows(sums, tops, found):
        frames = []
        for key, (lines, counts) in sums.items():
            held = found.get(key, [])
            fit = np.concatenate([f for f, _ in held]) if held else np.zeros(0, int)
            near = np.concatenate([v for _, v in held]) if held else np.zeros((0, 2 + p))
            order = np.argsort(fit, kind="stable")
            first = np.searchsorted(fit[order], np.arange(lines.shape[1] + 1))
            near = near[order]
            of = [near[a:b].ravel() for a, b in zip(first[:-1], first[1:])]
            frames += [[*key, int(j), int(counts[j]), lines[:, j], tops[key], of[j]] for j in np.flatnonzero(shared.value[key]["open"])]
        return pd.DataFrame(frames, columns=[*keys, "fit", "n", "lines", "top", "near"])

    def partial(batches):
        sums, tops, found, held = {}, {}, {}, 0
        for pdf in batches:
            for key, base, targets in read(pdf):
                s = shared.value.get(key)
                if s is None or not s["open"].any():
                    continue
                x, r = base[:, : 1 + p], _residuals(base, targets, s, p)
                beyond = np.abs(r) - epsilon
                near = np.abs(beyond) <= s["w"]
                far = ((beyond > 0) & ~near).astype(float)
                loss = np.einsum("ij,ij->j", far, beyond)
                slope = x.T @ (np.sign(r) * far)
                lines = C * np.vstack([slope, loss + (slope * s["b"]).sum(axis=0)])
                total, counts = sums.setdefault(key, (np.zeros_like(lines), np.zeros(lines.shape[1], int)))
                total += lines
                tops[key] = np.maximum(tops.get(key, 0.0), np.abs(x).max(axis=0))
                near &= s["open"]
                counts += near.sum(axis=0)
                # Too many near rows end the attempt, so none need be held.
                near[:, counts > 2 * NEAR] = False
                fit, row = np.nonzero(near.T)
                if len(fit):
                    z = r[row, fit] + np.einsum("ij,ji->i", x[row], s["b"][:, fit])
                    found.setdefault(key, []).append((fit, np.column_stack([x[row], z])))
                    held += len(fit) * (2 + p)
                if held > HELD:
                    yield out_rows(sums, tops, found)
                    sums, tops, found, held = {}, {}, {}, 0
        if sums:
            yield out_rows(sums, tops, found)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        key, j, n = tuple(pdf[k].iloc[0] for k in keys), int(pdf["fit"].iloc[0]), int(pdf["n"].sum())
        b, reached, s = None, float("inf"), shared.value[key]
        if n <= 2 * NEAR:
            near = np.concatenate(list(pdf["near"])).reshape(n, 2 + p)
            width = float(s["w"][j])
            fit = Fit(s["b"][:, j], min(width, WIDTHS[-1]) / 48 / C, C, tol, epsilon, 1.0, centre=s["b"][:, j], width=width)
            b, reached = fit.finish(np.sum(list(pdf["lines"]), axis=0), np.max(list(pdf["top"]), axis=0), near)
        return pd.DataFrame([[*key, j, n, b, reached]], columns=[*keys, "fit", "n", "b", "reached"])

    named = f"{study.schema}, fit int, n long"
    few = rows.mapInPandas(partial, f"{named}, lines array<double>, top array<double>, near array<double>")
    # A fit's end is long work on few bytes, so small partitions must not be put together.
    few = few.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, *keys, "fit")
    ended = few.groupBy(*keys, "fit").applyInPandas(finish, f"{named}, b array<double>, reached double").toPandas()
    shared.destroy()
    return ended.assign(fit=which[ended["fit"]])


def _end(study: Study, rows: DataFrame, state: dict) -> None:
    """Brings `b` of all fits to the optimum, proven by the gap over all rows."""
    for s in state.values():
        s["open"] = np.ones(len(study.names), bool)
        s["w"] = np.full(len(study.names), np.inf) if s["n"] <= NEAR else s["h"] * np.minimum(NEAR / s["k"], 1.0)
    for _ in range(_MOST_CENTRES):
        for *key, j, n, b, reached in _last_rows(study, rows, state)[[*study.keys, "fit", "n", "b", "reached"]].itertuples(index=False, name=None):
            s = state[tuple(key)]
            if b is None:
                s["w"][j] *= min(0.5, NEAR / max(n, 1))
                continue
            s["open"][j] = reached > s["w"][j]
            if not s["open"][j] or reached <= 16 * s["w"][j]:
                s["b"][:, j] = np.array(b)
        if not any(s["open"].any() for s in state.values()):
            return
    # What is still open goes on by passes over all rows, each step under the objective.
    p, epsilon, C = len(study.features), study.epsilon, study.C
    fits = {(key, str(j)): Fit(s["b"][:, j].copy(), 0.1 / C, C, study.tol, epsilon, 1.0, most_near=START_ROWS) for key, s in state.items() for j in np.flatnonzero(s["open"])}
    parts = {at: int(at[1]) for at in fits}
    which = sorted(set(parts.values()))
    scales = {key: {"resid": s["resid"][:, which], "sd": s["sd"][which], "b": np.zeros((1 + p, len(which)))} for key, s in state.items()}
    read = study.pieces(which)

    def one(mine, wanted):
        for key, base, targets in read(mine):
            z = _residuals(base, targets, scales[key], p)
            for j in wanted:
                yield j, base[:, : 1 + p], z[:, which.index(j)]

    for (key, name), fit in settle(rows, study.keys, fits, parts, one, "support vector regression").items():
        state[key]["b"][:, int(name)] = fit.b


def svr_target_scores(study: Study, floor: bool = False) -> DataFrame:
    """(groups..., model, target, n, sp, spp, sy, syy, spy): held-out sums of every target's support vector regression; groups are the keys but `run`.

    Targets are residualized on the covariates and scaled by the training rows of their run. `floor` clips predictions at zero.
    """
    spark, p, keys = study.rows.sparkSession, len(study.features), list(study.keys)
    numbers, extra = [*study.features, *study.covariates, study.target], [c for c in (study.place, *study.block.columns) if c not in (study.place, study.target)]
    known = study.rows.where(complete([*study.features, *study.covariates]))
    picked = known.select(*keys, "is_train", study.place, *dict.fromkeys(extra), *[F.col(c).cast("double").alias(c) for c in numbers])
    # Rows of one place side by side, in two parts per core: few bytes, but long work.
    picked = stage(picked.repartition(2 * spark.sparkContext.defaultParallelism, study.place).sortWithinPartitions(study.place))
    train, held = picked.where("is_train").dropna("any", subset=numbers), picked.where("not is_train")
    state = scale_targets(study, _sums(study, train, _moments))
    most = max((s["n"] for s in state.values()), default=0)

    def some(rows: int) -> DataFrame:
        return stage(train.where(F.pmod(F.xxhash64(study.place, F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * rows / most)))

    rows, now = min(START_ROWS, most), some(START_ROWS) if most > START_ROWS else train
    for h in WIDTHS:
        _step(study, now, state, lambda s: h)
    # Each step is over more rows and nearer to the corners than the one before.
    while rows < most:
        rows = 4 * rows if 16 * rows < most else most
        now = some(rows) if rows < most else train
        _step(study, now, state, lambda s: s["h"] * np.minimum(min(WITHIN, rows / 4) / s["k"] * s["n"] / min(rows, s["n"]), 1.0))
    if state:
        _end(study, train, state)

    def score(base, targets, s):
        yhat = s["mean"] + s["sd"] * (base[:, : 1 + p] @ s["b"])
        yhat = np.maximum(yhat, 0.0) if floor else yhat
        own = s["resid"].copy()
        own[0] -= s["mean"]
        y = targets - base @ own
        return np.stack([yhat.sum(axis=0), (yhat * yhat).sum(axis=0), y.sum(axis=0), (y * y).sum(axis=0), (yhat * y).sum(axis=0)]), np.array([float(len(base))])

    groups, pooled = [k for k in keys if k != "run"], {}
    for key, (wide, (n,)) in _sums(study, held, score, state).items():
        group = tuple(k.item() if hasattr(k, "item") else k for name, k in zip(keys, key) if name != "run")
        seen, sums = pooled.get(group, (0.0, 0.0))
        pooled[group] = seen + n, sums + wide
    kinds = dict(study.rows.dtypes)
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in groups], "model string, target string, n double, sp double, spp double, sy double, syy double, spy double"])
    found = [(*g, "svr", name, float(n), *map(float, v)) for g, (n, sums) in pooled.items() for name, v in zip(study.names, sums.T)]
    return spark.createDataFrame(found, schema)
