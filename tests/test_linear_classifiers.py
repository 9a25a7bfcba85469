"""Grouped classifiers against fits of each group, fold, setting and subset on its own."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varve.models import linear_classifiers as L
from varve.models.svr import Fit
from varve.operators.shuffles import donors, round_keys
from varve.session import spread, stage

P = 4


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(3)
    n = 360
    x = rng.normal(size=(n, P)).round(2)
    y = (x @ [1.0, -0.5, 0.0, 0.3] + rng.logistic(size=n) > 0.8).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.arange(n) % 2, "part": np.arange(n) // 2 % 3, "y": y, "x": list(x)})
    return pdf, stage(spark.createDataFrame(pdf).repartition(5))


def logistic_by_hand(x, y, C, balanced):
    """Gradient steps on the whole objective, long enough to be exact."""
    a = np.column_stack([np.ones(len(y)), x])
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())) if balanced else np.ones(len(y))
    hold = np.r_[0.0, np.ones(x.shape[1])]
    rate = 1 / (1 + C * np.linalg.norm(a * np.sqrt(w)[:, None], 2) ** 2 / 4)
    b = far = np.zeros(a.shape[1])
    for k in range(60_000):
        to = far + rate * (C * a.T @ (w * (y - 1 / (1 + np.exp(-a @ far)))) - hold * far)
        b, far = to, to + k / (k + 3) * (to - b) if k % 400 else to
    return b


def hinge_objective(b, x, y, C):
    return b[1:] @ b[1:] / 2 + C * np.maximum(1 - (2 * y - 1) * (b[0] + x @ b[1:]), 0).sum()


def hinge_by_hand(x, y, C):
    """The dual by pairs of rows that break its conditions most; the intercept from the rows between the limits."""
    s = 2.0 * y - 1
    a, gram = np.zeros(len(y)), x @ x.T
    f = np.zeros(len(y))
    for _ in range(200_000):
        room_up, room_down = np.where(s > 0, a < C, a > 0), np.where(s > 0, a > 0, a < C)
        gain = s - f
        i, j = np.argmax(np.where(room_up, gain, -np.inf)), np.argmin(np.where(room_down, gain, np.inf))
        if gain[i] - gain[j] < 1e-10:
            break
        step = (gain[i] - gain[j]) / max(gram[i, i] + gram[j, j] - 2 * gram[i, j], 1e-12)
        step = min(step, C - a[i] if s[i] > 0 else a[i], a[j] if s[j] > 0 else C - a[j])
        a[i], a[j] = a[i] + s[i] * step, a[j] - s[j] * step
        a[[i, j]] = np.where(np.abs(a[[i, j]]) < 1e-13, 0, np.where(np.abs(a[[i, j]] - C) < 1e-13, C, a[[i, j]]))
        f = f + step * (gram[i] - gram[j])
    return np.r_[(gain[i] + gain[j]) / 2, (a * s) @ x]


@pytest.mark.parametrize("kind", ["logistic", "svm"])
def test_every_member_equals_its_own_fit(cases, kind):
    pdf, df = cases
    members = [L.Member(f"{C}|{j}", (("C", C),), j) for C in (0.05, 2.0) for j in (None, 0, 2)]
    got = L.fit_members(df, kind, ["g"], members, "part")
    assert len(got) == 2 * len(members)
    for ((g,), name), b in got.items():
        C, j = name.split("|")
        mine = pdf[(pdf.g == g) & (pdf.part.astype(str) != j)]
        x, y = np.stack(mine.x), mine.y.to_numpy()
        if kind == "logistic":
            assert np.allclose(b, logistic_by_hand(x, y, float(C), True), atol=1e-4)
        else:
            best = hinge_by_hand(x, y, float(C))
            assert np.allclose(b[1:], best[1:], atol=2e-4)
            assert hinge_objective(b, x, y, float(C)) <= hinge_objective(best, x, y, float(C)) * (1 + 1e-4)


def test_draws_are_balanced_subsets(cases):
    pdf, df = cases
    rows = L.numbered(df, "id", ["g"])
    members = [L.Member(str(m), draw=m) for m in range(12)]
    got = L.fit_members(rows, "logistic", ["g"], members, draws=12)
    held, keys, sets = rows.toPandas(), round_keys(12, 42, "balanced subset"), set()
    for ((g,), name), b in got.items():
        mine = held[held.g == g]
        few = mine.y.value_counts().min()
        taken = pd.concat([c[donors(c._slot.to_numpy(), len(c), keys[:, [int(name)]])[:, 0] < few] for _, c in mine.groupby("y")])
        assert (taken.y.value_counts() == few).all()
        sets.add(frozenset(taken.id))
        assert np.allclose(b, logistic_by_hand(np.stack(taken.x), taken.y.to_numpy(), 0.1, True), atol=1e-4)
    assert len(sets) == 24
    mean = L.mean_scores(df, "logistic", ["g"], got, members, ["id"]).toPandas().set_index("id").score
    tall = L.score_rows(df, "logistic", ["g"], got, members, ["id"]).groupBy("id").agg(F.avg("score").alias("s")).toPandas().set_index("id").s
    assert np.allclose(mean.sort_index(), tall.sort_index())


def test_rows_are_scored_by_the_fit_that_left_them_out(cases):
    pdf, df = cases
    members = [L.Member(str(j), without=j) for j in range(3)]
    coefs = L.fit_members(df, "svm", ["g"], members, "part")
    out = L.score_rows(df, "svm", ["g"], coefs, members, ["id"], "part").toPandas().set_index("id")
    assert len(out) == len(pdf)
    for r in pdf.itertuples():
        b = coefs[(r.g,), str(r.part)]
        assert out.score[r.id] == pytest.approx(b[0] + r.x @ b[1:]) and out.member[r.id] == str(r.part)


def test_one_class_separable_and_flat_groups(spark):
    rows = [(0, 1, [1.0]), (0, 1, [2.0]), (1, 0, [-1.0]), (1, 1, [1.0]), (2, 0, [3.0]), (2, 1, [3.0])]
    df = stage(spark.createDataFrame(rows, "g int, y int, x array<double>"))
    for kind, sure in L.ONE_CLASS.items():
        got = L.fit_members(df, kind, ["g"], [L.Member("m", (("C", 100.0),))])
        assert np.allclose(got[(0,), "m"], [sure, 0.0])
        assert got[(1,), "m"][1] > 0.9 and np.allclose(got[(2,), "m"][1], 0.0, atol=1e-6)


def test_a_fit_that_does_not_settle_raises(cases):
    with pytest.raises(RuntimeError, match="did not settle"):
        L.fit_members(cases[1], "svm", ["g"], [L.Member("m")], most_passes=2)


def test_platt_curve_is_the_likeliest(spark):
    rng = np.random.default_rng(4)
    score = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(1.5 * score - 0.4)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"k": 0, "score": score, "y": y}))
    b = L.platt_curves(df, ["k"])[(0,)]
    p = 1 / (1 + np.exp(-(b[0] + b[1] * score)))
    assert abs((y - p).sum()) < 1e-3 and abs(((y - p) * score).sum()) < 1e-3
    assert L.platt_curves(df.withColumn("y", F.lit(1)), ["k"]) == {}


@pytest.mark.parametrize("share,rounded", [(0.03, False), (0.1, True), (0.5, False)])
def test_hinge_fits_without_signal_settle(share, rounded):
    """Rare classes without signal have best coefficients at or near 0; the fit ends all the same, at the optimum."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 4))
    x = x.round() if rounded else x
    y = (rng.random(200) < share).astype(int)
    for C in (0.01, 1.0):
        fit, passes = L.new_fit("svm", 4, (y == 0).sum(), y.sum(), {"C": C}), 0
        while not fit.done and passes < 500:
            fit.advance(fit.sums(np.column_stack([np.ones(200), x]), 2.0 * y - 1))
            passes += 1
        assert fit.done and np.allclose(fit.b[1:], hinge_by_hand(x, y, C)[1:], atol=2e-4)


def test_hinge_fits_of_many_rows_need_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20_000, 6))
    y = (x[:, 0] + 3 * rng.normal(size=20_000) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "part": np.arange(20_000) % 2, "y": y, "x": list(x)}))
    rows = stage(spread(df.select("g", "part", F.col("y").cast("int").alias("y"), "x"), ["g", "part"]))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    passes, step = Counter(), Fit.advance
    monkeypatch.setattr(Fit, "advance", lambda self, sums: (passes.update([id(self)]), step(self, sums))[1])
    found = L.fit_members(rows, "svm", ["g"], [L.Member(f"{C}", (("C", C),), 0) for C in (0.01, 1.0)], "part")
    monkeypatch.undo()
    assert len(passes) == 2 and max(passes.values()) <= 25
    use, t = np.column_stack([np.ones(10_000), x[1::2]]), 2.0 * y[1::2] - 1
    for C in (0.01, 1.0):
        fit = L.new_fit("svm", 6, (t < 0).sum(), (t > 0).sum(), {"C": C})
        while not fit.done:
            fit.advance(fit.sums(use, t))
        assert np.allclose(found[(0,), f"{C}"], fit.b, atol=1e-4)
