"""Inner tuning against refitting every split and candidate by hand."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from varve.models import gram as G
from varve.models import regression as R
from varve.models import tuning as T
from varve.models.svr import Fit, Variant, fit_svr_variants

GRID = {"ridge": {"alpha": [0.01, 30.0, 3000.0]}, "elastic_net": {"alpha": [0.001, 0.2], "l1_ratio": [0.1, 0.9]}}
X = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(11)
    n = 240
    x = rng.normal(size=(n, 4))
    age = rng.integers(8, 15, n)
    y = 10 + 2 * x[:, 0] - x[:, 1] + 0.5 * age + rng.normal(0, 3, n)
    pdf = pd.DataFrame(x, columns=X).assign(id=np.arange(n), y=y, age=age.astype(float), site=[f"s{i % 3}" for i in range(n)], fam=np.arange(n) // 2)
    spec = R.Spec("id", "y", tuple(X), "site", ("age",), ("age",), family="fam", folds=3, harmonize=False)
    prepared = R.prepare(spark.createDataFrame(pdf), spec, inner=3)
    from varve.session import stage

    return prepared, stage(prepared.frame())


def linear_fit(x, y, alpha, l1):
    """Coordinate descent from zero on the rows themselves, for any penalty."""
    xc, yc = x - x.mean(0), y - y.mean()
    if not l1:
        b = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    else:
        b = np.zeros(x.shape[1])
        for _ in range(3000):
            for g in range(len(b)):
                r = yc - xc @ b + xc[:, g] * b[g]
                c = xc[:, g] @ r / len(y)
                b[g] = np.sign(c) * max(abs(c) - alpha * l1, 0) / (xc[:, g] @ xc[:, g] / len(y) + alpha * (1 - l1))
    return lambda z: y.mean() + (z - x.mean(0)) @ b


def residual(train, rows):
    a = np.column_stack([np.ones(len(train)), train.age])
    terms = np.linalg.lstsq(a, train.y, rcond=None)[0]
    return rows.y.to_numpy() - np.column_stack([np.ones(len(rows)), rows.age]) @ terms


def by_hand(pdf, points, scoring):
    """{run: (scores by candidate, held-out predictions of the best)}."""
    out = {}
    for run in sorted(pdf.run.unique()):
        mine = pdf[pdf.run == run]
        train, test = mine[mine.is_train], mine[~mine.is_train]
        y, x = residual(train, train), train[X].to_numpy()
        scores = []
        for alpha, l1 in points:
            folds = []
            for v in sorted(train.inner.unique()):
                use = (train.inner != v).to_numpy()
                p, t = linear_fit(x[use], y[use], alpha, l1)(x[~use]), y[~use]
                folds.append({"neg_mae": -np.abs(p - t).mean(), "neg_mse": -((p - t) ** 2).mean(), "pearson_r": np.corrcoef(p, t)[0, 1]}[scoring])
            scores.append(np.mean(folds))
        best = int(np.argmax(scores))
        out[run] = (scores, best, linear_fit(x, y, *points[best])(test[X].to_numpy()), test.id.to_numpy())
    return out


@pytest.mark.parametrize("scoring", T.SCORES)
def test_choices_and_predictions_equal_refitting(study, scoring):
    prepared, frame = study
    pdf = frame.toPandas()
    choices, best, _ = R.tuned(prepared, frame, GRID, scoring)
    chosen = choices.toPandas().set_index(["model", "run"])
    preds = R.predict(prepared, frame, best).toPandas()
    points = {"ridge": [(a, 0.0) for a in GRID["ridge"]["alpha"]], "elastic_net": [(a, r) for a in GRID["elastic_net"]["alpha"] for r in GRID["elastic_net"]["l1_ratio"]]}
    for model, some in points.items():
        for run, (scores, place, yhat, ids) in by_hand(pdf, some, scoring).items():
            assert chosen.loc[(model, run), "place"] == place and chosen.loc[(model, run), "score"] == pytest.approx(scores[place], abs=1e-6)
            got = preds[(preds.model == model) & (preds.fold == run)].set_index("id").yhat.loc[ids]
            assert np.allclose(got, yhat, atol=1e-5)


def test_inner_folds_keep_families_and_cover_every_run(study):
    prepared, _ = study
    pdf = prepared.rows.toPandas()
    assert (pdf.groupby("fam")[["fold", "inner"]].nunique() == 1).all().all()
    assert (pdf.groupby(["fold", "inner"]).size().unstack() > 10).all().all()


def svr_by_hand(x, t, C, epsilon):
    """The solver's steps on rows in memory; its optimum is held against an exact dual solver in test_models."""
    rows = np.column_stack([np.ones(len(x)), x])
    fit = Fit(np.concatenate([[t.mean()], np.zeros(x.shape[1])]), t.std() / C, C, 1e-5, epsilon, t.std())
    while not fit.done:
        fit.advance(fit.sums(rows, t))
    return fit.b


def test_svr_candidates_are_fits_without_copies(study):
    prepared, frame = study
    _, train = R._svr_rows(prepared, frame, ["run"], prepared.spec, keep=["inner"])
    pdf = train.toPandas()
    grid = {"svr": {"C": [0.01, 1.0], "epsilon": [0.1]}}
    choices, best, preds = R.tuned(prepared, frame, grid, "neg_mae")
    assert best.count() == 0
    preds = preds.toPandas()
    assert len(preds) == 240
    held = frame.where("not is_train").toPandas()
    for r in choices.collect():
        rows, scores = pdf[pdf.run == r.run], []
        for C in grid["svr"]["C"]:
            folds = []
            for v in sorted(rows.inner.unique()):
                use, out = rows[rows.inner != v], rows[rows.inner == v]
                b = svr_by_hand(use[X].to_numpy(), use._z.to_numpy(), C, 0.1)
                folds.append(-np.abs(b[0] + out[X].to_numpy() @ b[1:] - out._z).mean())
            scores.append(np.mean(folds))
        assert r.place == int(np.argmax(scores)) and r.score == pytest.approx(max(scores), abs=1e-3)
        b = svr_by_hand(rows[X].to_numpy(), rows._z.to_numpy(), grid["svr"]["C"][r.place], 0.1)
        mine = held[held.run == r.run].set_index("id")
        yhat = rows._y.mean() + rows._y.std(ddof=0) * (b[0] + mine[X].to_numpy() @ b[1:])
        assert np.allclose(preds[preds.fold == r.run].set_index("id").yhat.loc[mine.index], yhat, atol=0.02)


def test_nested_cv_with_a_grid(study):
    prepared, _ = study
    out = R.nested_cv(prepared.rows.drop("fold", "inner"), prepared.spec, ("linear", "ridge"), grid={"ridge": {"alpha": [1.0]}}, scoring="pearson_r")
    plain = R.nested_cv(prepared.rows.drop("fold", "inner"), prepared.spec, ("linear", "ridge"))
    a, b = (o["metrics"].toPandas().sort_values(["model", "metric"]).value.to_numpy() for o in (out, plain))
    assert np.allclose(a, b) and {r.candidate for r in out["choices"].collect()} == {"alpha=1.0"}
    assert out["residual_terms"].count() == plain["residual_terms"].count()
    with pytest.raises(ValueError, match="none of"):
        R.tuned(*study, {"ridge": {"alpha": [1.0]}}, "accuracy")


def test_one_spectrum_serves_every_ridge_penalty():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 3)), rng.normal(size=(50, 2))
    z = np.column_stack([np.ones(50), x])
    solver = G.Solver(G.Moments(z.T @ z, z.T @ y, (y**2).sum(0)), [1, 2, 3])
    for alpha in (1e-6, 1.0, 1e4):
        xc = x - x.mean(0)
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ (y - y.mean(0)))
        assert np.allclose(solver.solve(G.Linear("ridge", alpha))[1:], want)


def test_svr_settles_where_hardly_a_row_is_free():
    """Tight limits on the dual values leave no row between them; the intercept must not be thrown about."""
    for seed in (191, 264):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(80, 180))
        x = rng.normal(size=(n, 4))
        y = 2 * x[:, 0] - x[:, 1] + rng.normal(0, 3, n)
        t = (y - y.mean()) / y.std() + rng.normal(0, 0.03)
        rows = np.column_stack([np.ones(n), x])
        for C in (0.001, 0.01):
            fit = Fit(np.concatenate([[t.mean()], np.zeros(4)]), t.std() / C, C, 1e-4, 0.1, t.std())
            for _ in range(100):
                fit.advance(fit.sums(rows, t))
                if fit.done:
                    break
            assert fit.done


def many_rows(hinge, n=30_000):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3))
    f = 0.3 * x[:, 0] - 0.1 * x[:, 1] + rng.standard_t(5, n)
    return x, np.where(f > 0, 1.0, -1.0) if hinge else f


@pytest.mark.parametrize("hinge", [False, True])
def test_last_steps_over_the_near_rows_give_the_fit_of_all_rows(hinge):
    x, t = many_rows(hinge)
    rows = np.column_stack([np.ones(len(x)), x])
    epsilon = 0.0 if hinge else 0.1
    for C in (0.01, 1.0):
        plain, fit = (Fit(np.concatenate([[t.mean()], np.zeros(3)]), t.std() / C, C, 1e-5, epsilon, t.std(), hinge=hinge) for _ in range(2))
        while not plain.done:
            plain.advance(plain.sums(rows, t))
        passes = 0
        while not fit.done and passes < 25:
            if fit.close:
                halves = [fit.split(rows[s], t[s]) for s in (slice(0, 9_000), slice(9_000, None))]
                lines, top, near = sum(h[0] for h in halves), np.maximum(halves[0][1], halves[1][1]), np.concatenate([h[2] for h in halves])
                assert len(near) < 8_192
                fit.move(*fit.finish(lines, top, near))
            else:
                fit.advance(fit.sums(rows, t))
            passes += 1
        assert fit.done and np.allclose(fit.b, plain.b, atol=1e-5)


def test_a_centre_with_too_many_near_rows_is_given_up():
    x, t = many_rows(False, 500)
    fit = Fit(np.zeros(4), 1.0, 1.0, 1e-4, centre=np.zeros(4), width=0.1)
    fit.move(None, float("inf"))
    assert not fit.close and not fit.done and fit.most_near == 1_024


def test_svr_of_many_rows_needs_few_passes(spark, monkeypatch):
    x, t = many_rows(False)
    passes, step = Counter(), Fit.advance
    monkeypatch.setattr(Fit, "advance", lambda self, sums: (passes.update([id(self)]), step(self, sums))[1])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(t=t, k=np.arange(len(t)) % 2, part=np.arange(len(t)) % 3))
    found = fit_svr_variants(df, list("abc"), "t", ["k"], lambda key: [Variant(f"{C}", C, 0.1, 1) for C in (0.1, 1.0)], "part")
    monkeypatch.undo()
    assert len(passes) == 4 and max(passes.values()) <= 25
    for k in (0, 1):
        use = (np.arange(len(t)) % 2 == k) & (np.arange(len(t)) % 3 != 1)
        for C in (0.1, 1.0):
            assert np.allclose(found[(k,), f"{C}"], svr_by_hand(x[use], t[use], C, 0.1), atol=1e-4)
