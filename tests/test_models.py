import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varve.models import classification as C
from varve.models import gram as G
from varve.models import regression as R
from varve.models.registry import assemble, parameter_grid, regressor, supports_weights
from varve.models.svr import fit_svr
from varve.operators import association as A
from varve.operators import combat as H
from varve.operators import evaluation as V
from varve.operators import weighting as W
from varve.operators.ols import ols

FEATURES = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def sites(spark):
    rng = np.random.default_rng(5)
    n = 240
    site = rng.integers(0, 3, n)
    age = rng.normal(10, 2, n)
    x = rng.normal(size=(n, 3)) * (1 + 0.5 * site[:, None]) + 3 * site[:, None] + 0.2 * age[:, None]
    y = 2 * rng.normal(size=n) + x[:, 0]
    pdf = pd.DataFrame(x, columns=FEATURES).assign(id=np.arange(n), site=[f"s{s}" for s in site], age=age, y=y, fold=np.arange(n) % 4, fam=np.arange(n) // 2)
    return pdf, spark.createDataFrame(pdf).repartition(5)


def row_level_combat(pdf, features, eb):
    """The published steps written over rows, for a small table."""
    s = pd.get_dummies(pdf.site).to_numpy(float)
    c = pdf[["age"]].to_numpy(float)
    x = pdf[features].to_numpy(float)
    design = np.hstack([s, c])
    coef = np.linalg.lstsq(design, x, rcond=None)[0]
    alpha = (s.sum(0) / len(x)) @ coef[: s.shape[1]]
    sigma = np.sqrt(((x - design @ coef) ** 2).mean(0))
    stand = alpha + c @ coef[s.shape[1] :]
    z = (x - stand) / sigma
    out = z.copy()
    for j in range(s.shape[1]):
        rows = s[:, j] == 1
        n, zi = rows.sum(), z[rows]
        g, d = zi.mean(0), zi.var(0, ddof=1)
        if eb:
            gbar, t2, m, v = g.mean(), g.var(ddof=1), d.mean(), d.var(ddof=1)
            a, b = (2 * v + m * m) / v, (m * v + m**3) / v
            gs, ds = g, d
            for _ in range(1000):
                gs = (t2 * n * g + ds * gbar) / (t2 * n + ds)
                ds = (b + 0.5 * ((zi - gs) ** 2).sum(0)) / (n / 2 + a - 1)
            g, d = gs, ds
        out[rows] = (zi - g) / np.sqrt(d)
    return out * sigma + stand


@pytest.mark.parametrize("eb", [False, True])
def test_combat_from_moments_equals_row_level(sites, eb):
    pdf, df = sites
    got = H.fit_site_model(df, FEATURES, "site", ["age"], eb=eb).apply(df).toPandas().sort_values("id")
    assert np.abs(got[FEATURES].to_numpy() - row_level_combat(pdf, FEATURES, eb)).max() < (2e-3 if eb else 1e-8)


def test_combat_invariants(sites):
    pdf, df = sites
    flat = H.fit_site_model(df, FEATURES, "site", eb=False).apply(df).toPandas()
    by = flat.groupby("site")[FEATURES]
    assert by.mean().std().max() < 1e-9 and by.std().std().max() < 1e-9
    one = df.where("site = 's0'")
    kept = H.fit_site_model(one, FEATURES, "site").apply(one).toPandas().sort_values("id")
    assert np.allclose(kept[FEATURES], pdf[pdf.site == "s0"][FEATURES])
    shrunk = H.fit_site_model(df, FEATURES, "site", eb=True).apply(df).toPandas()
    assert shrunk.groupby("site")[FEATURES].mean().std().max() < pdf.groupby("site")[FEATURES].mean().std().max()


def test_fold_fits_equal_subset_fits(sites):
    _, df = sites
    runs = H.fit_site_model(df, FEATURES, "site", ["age"], "fold", 4).apply(W.runs(df, "fold", 4))
    got = runs.where("run = 2 and not is_train").toPandas().sort_values("id")
    alone = H.fit_site_model(df.where("fold <> 2"), FEATURES, "site", ["age"]).apply(df.where("fold = 2")).toPandas().sort_values("id")
    assert np.allclose(got[FEATURES], alone[FEATURES], atol=1e-6)


def test_unseen_site_is_null_and_small_input_stays_raw(sites):
    _, df = sites
    model = H.fit_site_model(df.where("site <> 's2'"), FEATURES, "site")
    out = model.apply(df)
    assert out.where("site = 's2'").agg(F.count("f0")).first()[0] == 0
    few = df.where("id < 20")
    assert not any(r["harmonized"] for r in H.harmonize_guarded(few, FEATURES, "site", min_site_n=1).collect())


def test_linear_family_against_mllib_and_algebra(sites, spark):
    pdf, df = sites
    tall = df.withColumn("run", F.lit(0)).withColumn("is_train", F.col("fold") != 0)
    models = [G.Linear("linear"), G.Linear("ridge", 5.0), G.Linear("elastic_net", 0.1, 0.5)]
    fits = {r["model"]: np.array(r["coef"]) for r in G.fit_runs(tall, FEATURES, [], ["y"], models).collect()}
    train = pdf[pdf.fold != 0]
    x = train[FEATURES].to_numpy()
    xc, yc = x - x.mean(0), train.y - train.y.mean()
    ridge = np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ yc)
    assert np.allclose(fits["ridge"][1:], ridge) and fits["ridge"][0] == pytest.approx(train.y.mean() - x.mean(0) @ ridge)
    ready = assemble(df.where("fold <> 0"), FEATURES)
    params = {"linear": {}, "ridge": {"alpha": 5.0}, "elastic_net": {"alpha": 0.1, "l1_ratio": 0.5}}
    for name, kw in params.items():
        est = regressor(name, rows=float(len(train)), y_sd=float(train.y.std(ddof=0)), **kw)
        assert np.allclose(fits[name][1:], est.setTol(1e-12).setMaxIter(1000).fit(ready).coefficients.toArray(), atol=1e-4), name


def test_pooled_sums_equal_row_predictions(sites):
    _, df = sites
    spec = R.Spec("id", "y", tuple(FEATURES), "site", ("age",), ("age",), family="fam", folds=3)
    prepared = R.prepare(df, spec)
    frame = prepared.frame()
    fitted = R.fits(prepared, frame)
    preds = R.predict(prepared, frame, fitted)
    rows = V.regression_metrics(preds, "y", "yhat").toPandas().set_index("metric").value
    sums = G.pooled_r(fitted).first()
    assert sums["n"] == preds.count() == df.count()
    assert sums["pearson_r"] == pytest.approx(rows["pearson_r"], abs=1e-9) and sums["r2"] == pytest.approx(rows["r2"], abs=1e-9)


def test_ols_matches_lstsq(sites):
    pdf, df = sites
    out = ols(df, "y", ["f0", "age"]).toPandas().set_index("term")
    x = np.column_stack([np.ones(len(pdf)), pdf.f0, pdf.age])
    beta, rss = np.linalg.lstsq(x, pdf.y, rcond=None)[:2]
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (len(pdf) - 3))
    assert np.allclose(out.loc[["intercept", "f0", "age"], "beta"], beta) and np.allclose(out.loc[["intercept", "f0", "age"], "se"], se)


def test_svr_is_at_the_optimum(sites):
    pdf, df = sites
    one = df.withColumn("k", F.lit(0))
    beta = fit_svr(one, FEATURES, "y", ["k"], C=1.0, epsilon=0.1)[(0,)]
    x = np.column_stack([np.ones(len(pdf)), pdf[FEATURES]])

    def loss(b):
        return 0.5 * (b[1:] ** 2).sum() + np.maximum(np.abs(pdf.y - x @ b) - 0.1, 0).sum()

    rng = np.random.default_rng(0)
    best = min(loss(beta + rng.normal(size=4) * s) for s in (0.3, 0.1, 0.03, 0.01, 0.003) for _ in range(300))
    assert loss(beta) <= best * (1 + 1e-9)


def exact_svr(x, y, C, epsilon):
    """The dual solved one pair of values at a time: with the sum fixed at 0, only pairs can move."""
    n, gram = len(y), x @ x.T
    a, f = np.zeros(n), np.zeros(n)
    for _ in range(200_000):
        rise = np.where(a < C, y - f - np.where(a >= 0, epsilon, -epsilon), -np.inf)
        fall = np.where(a > -C, y - f - np.where(a > 0, epsilon, -epsilon), np.inf)
        i, j = int(np.argmax(rise)), int(np.argmin(fall))
        if rise[i] - fall[j] < 1e-10:
            break
        step = (rise[i] - fall[j]) / max(gram[i, i] + gram[j, j] - 2 * gram[i, j], 1e-12)
        step = min(step, (-a[i] if a[i] < 0 else C - a[i]), (a[j] if a[j] > 0 else C + a[j]))
        a[i], a[j], f = a[i] + step, a[j] - step, f + step * (gram[i] - gram[j])
        a[np.abs(a) < 1e-13] = 0.0
    return a @ x


@pytest.mark.parametrize("ties", [False, True])
def test_svr_coefficients_match_the_dual(spark, ties):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(160, 4))
    y = x @ [0.5, -0.2, 0.0, 0.1] + rng.standard_t(4, size=160)
    if ties:
        x, y = np.repeat(x[:40], 4, 0).round(1), np.repeat(y[:40], 4).round(1)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(y=y, k=np.arange(160) % 2))
    out = fit_svr(df, list("abcd"), "y", ["k"], C=0.5, epsilon=0.2)
    for k in (0, 1):
        assert np.allclose(out[(k,)][1:], exact_svr(x[k::2], y[k::2], 0.5, 0.2), atol=1e-4)


def test_svr_of_a_flat_target_is_flat(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1.0, 2.0, 3.0], "y": [4.0, 4.0, 4.0], "k": 0}))
    assert np.allclose(fit_svr(df, ["x"], "y", ["k"])[(0,)], [4.0, 0.0])


def test_svr_studies(sites):
    from varve.plans import robustness as B

    _, df = sites
    spec = R.Spec(id="id", target="y", features=tuple(FEATURES), site="site", covariates=("age",), residualize=("age",), family="fam", folds=3)
    null, p = R.permutation_null(df, spec, 3, "svr")
    one = R.nested_cv(df, spec, (), svr=True)["metrics"].where("metric = 'pearson_r'").first()
    assert null.count() == 3 and p.first()["observed"] == pytest.approx(one["value"]) and one["model"] == "svr"
    out = B.leave_one_out(df, spec, "svr").toPandas().set_index("feature")
    assert out.delta_r.idxmax() == "f0" and len(out) == 3
    assert len(B.split_halves(df, spec, 2, "svr")[0].dropna().collect()) == 2


def test_auc_and_adjustment_invariants(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"y": rng.integers(0, 2, 300), "s": rng.normal(size=300).round(1), "p": rng.random(300)})
    df = spark.createDataFrame(pdf)
    a = V.roc_auc(df, "y", "s").first()["auc"]
    b = V.roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first()["auc"]
    pos, neg = pdf.s[pdf.y == 1].to_numpy(), pdf.s[pdf.y == 0].to_numpy()
    brute = (np.sign(pos[:, None] - neg[None, :]) + 1).mean() / 2
    assert a == pytest.approx(brute) and a + b == pytest.approx(1.0)
    assert V.roc_auc(df.where("y = 1"), "y", "s").first()["auc"] is None
    out = A.adjust(df, "p").toPandas().sort_values("p")
    assert out.p_fdr.is_monotonic_increasing and (out.p_fdr >= out.p).all() and (out.p_bonferroni >= out.p_fdr - 1e-12).all()


def test_pca_whitening_and_signs(sites):
    _, df = sites
    scaled = W.apply_scaler(df, W.fit_scaler(df, FEATURES), FEATURES)
    comps = W.fit_pca(scaled, FEATURES, 0.999, whiten=True)
    out = comps.transform(scaled, total_variance=3 * 240 / 239).toPandas()
    assert np.allclose(out[[f"PC{j + 1}" for j in range(comps.k)]].std(), 1.0, atol=1e-6)
    assert sum(comps.explained) <= 1 + 1e-9


def test_registry_and_grid():
    assert not supports_weights("svr") and supports_weights("svr", {"svr": {"supports_sample_weight": True}})
    assert parameter_grid({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def generated_cases(n0, n1, p, informative, separation, noise, seed=0):
    rng = np.random.default_rng(seed)
    y = np.r_[np.zeros(n0), np.ones(n1)]
    site = rng.integers(0, 3, n0 + n1)
    x = rng.normal(0, noise, (n0 + n1, p))
    x[y == 1, :informative] += separation
    x = x * (1 + 0.2 * site[:, None]) + site[:, None]
    return pd.DataFrame(x, columns=[f"f{i}" for i in range(p)]).assign(id=np.arange(n0 + n1), y=y.astype(int), site=[f"s{s}" for s in site])


@pytest.mark.parametrize("name,bar", [("svm", 0.80), ("random_forest", 0.80)])
def test_strong_signal_is_found(spark, name, bar):
    pdf = generated_cases(400, 40, 20, 6, 3.0, 0.5)
    task = C.Task("id", "y", tuple(f"f{i}" for i in range(20)), "site", folds=2, inner_folds=2, params={"max_iter": 20} if name == "svm" else {"n_estimators": 20})
    out = C.nested_cv(spark.createDataFrame(pdf), task, name)["metrics"].where(f"model = '{name}'").toPandas().set_index("metric").value
    assert out["balanced_accuracy"] > bar


def test_strong_regression_signal(spark):
    rng = np.random.default_rng(4)
    n, p = 600, 20
    site = rng.integers(0, 3, n)
    x = rng.normal(size=(n, p))
    y = np.clip(8 + 4 * 0.5 * x[:, :10].sum(1) / 10**0.5 + rng.normal(0, 3, n), 0, 20)
    pdf = pd.DataFrame(x * (1 + 0.2 * site[:, None]) + site[:, None], columns=[f"f{i}" for i in range(p)]).assign(id=np.arange(n), y=y, site=[f"s{s}" for s in site])
    spec = R.Spec("id", "y", tuple(f"f{i}" for i in range(p)), "site", folds=4)
    out = R.nested_cv(spark.createDataFrame(pdf), spec)["metrics"].toPandas().set_index("metric").value
    assert out["pearson_r"] > 0.35


def test_long_adjustment_equals_windowed_one(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": np.arange(400), "g": rng.choice(["a", "b"], 400), "p": rng.random(400).round(2)})
    pdf.loc[::50, "p"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("p", F.when(~F.isnan("p"), F.col("p")))
    a, b = (fn(df, "p", ["g"]).toPandas().sort_values("id")[["p_bonferroni", "p_fdr"]].to_numpy(float) for fn in (A.adjust, A.adjust_many))
    assert np.allclose(a, b, equal_nan=True)


def test_registered_svc_fits_settle(spark, monkeypatch):
    """The linear classifiers of a study are fitted together and end by their own rule; a lower limit of passes raises."""
    from varve.models import linear_classifiers as L
    from varve.plans.catalog import QUERIES

    fitted, inner = [], L.fit_members
    monkeypatch.setattr(L, "fit_members", lambda *a, **k: fitted.append((a[1], inner(*a, **k))) or fitted[-1][1])
    QUERIES["K18_cross_sectional_svc"](spark, "/root/testdata/sf0.01").collect()
    # One call for the baseline and one for the classifier, each with three runs and all of their inner folds.
    assert [(kind, len(found)) for kind, found in fitted] == [("logistic", 12), ("svm", 12)]
    monkeypatch.setattr(L, "fit_members", lambda *a, **k: inner(*a, **k, most_passes=2))
    with pytest.raises(RuntimeError, match="did not settle"):
        QUERIES["K18_cross_sectional_svc"](spark, "/root/testdata/sf0.01").collect()


@pytest.mark.parametrize("iterations,calibrate,grid", [(8, False, {}), (0, True, {"C": [0.01, 1.0]})])
def test_studies_with_subsets_settings_and_curves(spark, iterations, calibrate, grid):
    pdf = generated_cases(300, 60, 8, 4, 2.0, 1.0)
    task = C.Task("id", "y", tuple(f"f{i}" for i in range(8)), "site", folds=3, inner_folds=3, iterations=iterations, calibrate=calibrate, grid=grid)
    out = C.nested_cv(spark.createDataFrame(pdf), task, "svm")
    preds = out["predictions"].where("model = 'svm'").toPandas()
    assert sorted(preds.id) == list(range(360)) and preds.groupby("fold").threshold.nunique().max() == 1
    assert (preds.yhat == (preds.score >= preds.threshold)).all()
    assert not calibrate or preds.score.between(0, 1).all()
    value = out["metrics"].where("model = 'svm'").toPandas().set_index("metric").value
    assert value["balanced_accuracy"] > 0.8


def test_grid_search_equals_each_setting_alone(spark):
    pdf = generated_cases(120, 80, 5, 2, 0.8, 1.0)
    df = assemble(spark.createDataFrame(pdf), [f"f{i}" for i in range(5)]).select("id", F.col("y").cast("double").alias("y"), "x")
    task = C.Task("id", "y", (), grid={"C": [0.001, 0.1, 10.0]})
    best, tried = C.tune("logistic", df, task)
    for t in tried:
        alone = C.out_of_fold("logistic", df, task, t["params"], "tune")
        assert V.roc_auc(alone, "y", "score", ["inner"]).agg(F.avg("auc")).first()[0] == pytest.approx(t["score"])
    assert best == tried[0]["params"]


def test_pooled_regression_reads_its_input_once(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"fold": np.arange(400) % 4, "y": rng.normal(size=400).round(2)}).assign(p=lambda d: (d.y + rng.normal(size=400)).round(1))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame(pdf).mapInPandas(count, "fold long, y double, p double")
    out = V.pooled_regression(df, "y", "p", "fold").toPandas().set_index(["scope", "metric"]).value
    assert seen.value == 400
    assert out["overall", "spearman_r"] == pytest.approx(pdf.y.rank().corr(pdf.p.rank()))
    by = [g.y.rank().corr(g.p.rank()) for _, g in pdf.groupby("fold")]
    assert out["mean", "spearman_r"] == pytest.approx(np.mean(by)) and out["max", "spearman_r"] == pytest.approx(max(by))
