"""Registered queries for weighting, harmonization, models, longitudinal and robustness studies, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.functions.scalars import asymmetry
from varve.models import classification as C
from varve.models import gram as G
from varve.models import regression as R
from varve.models.registry import assemble, classifier
from varve.operators import association as A
from varve.operators import combat as H
from varve.operators import evaluation as V
from varve.operators import weighting as W
from varve.operators.ols import ols
from varve.operators.shuffles import shuffled_correlations
from varve.operators.splits import assign_folds
from varve.plans import longitudinal as N
from varve.plans import robustness as B
from varve.plans.catalog_prep import AI, BASE, VISITS, YEAR2, query, r6
from varve.plans.catalog_stats import AI_CTE, CHI, MENG, VERSUS, cohort_ai, corr_sql, poisson_sql, t_cols, t_sql
from varve.plans.visits import FEATURES, PAIRS, VISITS_SQL, table, visits
from varve.session import stage

DISC = ("qty_lh", "qty_rh", "price_lh", "price_rh")


def spec(**over):
    """The cohort study: four quantity and price features, site effects, age and sex covariates."""
    base = dict(
        id="id", target="target", features=DISC, site="site", covariates=("age", "sex"), residualize=("age", "sex"), family="family", folds=4,
        pairs=tuple(PAIRS[:2]),
    )
    return R.Spec(**{**base, **over})


def baseline_rows(spark, d):
    return visits(spark, d).where(F.col("yr") == BASE).where(F.col("sex").isin("1", "2"))


# --- G: weights, residuals, scaling, components ----------------------------------------------------


@query("G1_inverse_bin_weights", "with b as (select o_orderkey, cast(o_totalprice >= 100000 as int) + cast(o_totalprice >= 250000 as int) bin from orders) select o_orderkey, round((select count(*) from b) / (3 * count(*) over (partition by bin)), 6) as weight from b", cohort=False)
def g1(spark, d):
    return W.inverse_bin_weights(table(spark, d, "orders"), "o_totalprice", [0, 100_000, 250_000, 1e9]).select("o_orderkey", r6("weight"))


@query("G2_inverse_value_weights", "with c as (select event_id, 1.0 / count(*) over (partition by value) w from events) select event_id, round(w / (select avg(w) from c), 6) as weight from c", cohort=False)
def g2(spark, d):
    return W.inverse_value_weights(table(spark, d, "events").select("event_id", "value"), "value").select("event_id", r6("weight"))


@query("G3_balanced_class_weights", "select doc_id, round((select count(*) from labels) / (2.0 * count(*) over (partition by quality)), 6) as weight from labels", cohort=False)
def g3(spark, d):
    return W.balanced_class_weights(table(spark, d, "labels"), "quality").select("doc_id", r6("weight"))


@query("G4_residualize", "m as (select site, regr_slope(target, age) b, regr_intercept(target, age) a from visits group by site) select id, yr, round(target - (a + b * age), 4) as resid from visits join m using (site)")
def g4(spark, d):
    v = visits(spark, d).select("id", "yr", "site", "target", "age")
    model = W.fit_residualizer(v, "target", ["age"], ["site"])
    return W.apply_residualizer(v, model, "target", ["age"], ["site"], "resid").select("id", "yr", F.round("resid", 4).alias("resid"))


@query("G5_variance_filter", "select 'l_quantity' as feature, round(var_pop(l_quantity), 6) as variance from lineitem union all select 'l_tax', round(var_pop(l_tax), 6) from lineitem union all select 'flat', 0.0 from region where r_regionkey = 0", cohort=False)
def g5(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_tax", F.lit(1.0).alias("flat"))
    return W.feature_variances(li, ["l_quantity", "l_tax", "flat"]).select("feature", r6("variance"))


@query("G6_scale", "with m as (select o_orderpriority p, avg(o_totalprice) m, stddev_pop(o_totalprice) s from orders group by 1) select o_orderkey, round((o_totalprice - m) / s, 6) as o_totalprice from orders join m on p = o_orderpriority", cohort=False)
def g6(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return W.apply_scaler(o, W.fit_scaler(o, ["o_totalprice"], ["o_orderpriority"]), ["o_totalprice"], ["o_orderpriority"]).select("o_orderkey", r6("o_totalprice"))


@query("G6_unscale", "select o_orderkey, round(o_totalprice, 3) as o_totalprice from orders", cohort=False)
def g6b(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    s = stage(W.fit_scaler(o, ["o_totalprice"]))
    return W.apply_scaler(W.apply_scaler(o, s, ["o_totalprice"]), s, ["o_totalprice"], inverse=True).select("o_orderkey", F.round("o_totalprice", 3).alias("o_totalprice"))


def embedded(spark, d):
    """The embedding arrays as 64 columns, with a binary label and a site-like group."""
    e = table(spark, d, "embeddings")
    return e.select(
        "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)],
        (F.col("label") < 5).cast("int").alias("y"), (F.col("vec_id") % 3).cast("string").alias("site"),
    )


EMB = tuple(f"e{i}" for i in range(64))


@query("G7_pca")
def g7(spark, d):
    e = embedded(spark, d)
    scaled = W.apply_scaler(e, W.fit_scaler(e, EMB), EMB)
    comps = W.fit_pca(scaled, EMB, 0.9)
    return comps.transform(scaled).select("vec_id", *[f"PC{j + 1}" for j in range(comps.k)])


@query("G8_scree")
def g8(spark, d):
    e = embedded(spark, d)
    return W.scree(spark, W.fit_pca(e, EMB, 64))


@query("G9_component_importance", "with l as (select l_suppkey % 20 as component, l_linenumber as feature, avg(l_discount - 0.05) loading from lineitem group by 1, 2), i as (select l_suppkey % 20 as component, sum(l_quantity) importance from lineitem group by 1), top as (select * from i order by importance desc, component limit 10) select feature, round(sum(abs(loading) * importance), 4) as importance from l join top using (component) group by feature order by importance desc, feature limit 20", cohort=False)
def g9(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("component"), F.col("l_linenumber").alias("feature"), "l_discount", "l_quantity")
    loadings = li.groupBy("component", "feature").agg(F.avg(F.col("l_discount") - 0.05).alias("loading"))
    imp = li.groupBy("component").agg(F.sum("l_quantity").alias("importance"))
    return W.component_importance(loadings, imp).select("feature", F.round("importance", 4).alias("importance"))


@query("G10_fold_chain")
def g10(spark, d):
    prepared = R.prepare(baseline_rows(spark, d), spec())
    held = prepared.frame().where(~F.col("is_train"))
    return held.select("id", "run", *DISC)


# --- H: harmonization ------------------------------------------------------------------------------


@query("H1_covariate_frame", "c as (select sex, row_number() over (order by sex) - 1 k from (select distinct sex from visits)) select id, yr, site as \"SITE\", age, cast(k as double) as sex_code from visits join c using (sex)")
def h1(spark, d):
    frame, _ = H.harmonization_frame(visits(spark, d).withColumn("constant", F.lit(1.0)), ["id", "yr"], "site", ["age", "sex", "constant"])
    return frame


def _complete(spark, d):
    return visits(spark, d).dropna("any", subset=list(DISC))


PLAIN = "c as (select * from visits where qty_lh is not null and qty_rh is not null and price_lh is not null and price_rh is not null)"


@query(
    "H2_site_location_scale",
    f"{PLAIN}, s as (select site, count(*) n, avg(qty_lh) m, var_samp(qty_lh) v, var_pop(qty_lh) vp from c group by site), g as (select avg(qty_lh) m from c), p as (select sqrt(sum(n * vp) / sum(n)) sg from s) select id, yr, round((qty_lh - s.m) / sqrt(v) * sg + g.m, 5) as qty_lh from c join s using (site), g, p",
)
def h2(spark, d):
    c = _complete(spark, d)
    return H.fit_site_model(c, DISC, "site", eb=False).apply(c).select("id", "yr", F.round("qty_lh", 5).alias("qty_lh"))


@query(
    "H3_apply_to_new_rows",
    f"{PLAIN}, t as (select * from c where yr = 1995 and site <> 'BUILDING'), s as (select site, count(*) n, avg(qty_lh) m, var_samp(qty_lh) v, var_pop(qty_lh) vp from t group by site), g as (select avg(qty_lh) m from t), p as (select sqrt(sum(n * vp) / sum(n)) sg from s) select id, round((qty_lh - s.m) / sqrt(v) * (select sg from p) + (select m from g), 5) as qty_lh from c left join s using (site) where yr = 1997",
)
def h3(spark, d):
    c = _complete(spark, d)
    model = H.fit_site_model(c.where((F.col("yr") == BASE) & (F.col("site") != "BUILDING")), DISC, "site", eb=False)
    return model.apply(c.where(F.col("yr") == YEAR2)).select("id", F.round("qty_lh", 5).alias("qty_lh"))


@query("H3_unseen_sites", f"{PLAIN} select site, count(*) as rows from c where site = 'BUILDING' and yr = 1997 group by site")
def h3b(spark, d):
    c = _complete(spark, d)
    model = H.fit_site_model(c.where((F.col("yr") == BASE) & (F.col("site") != "BUILDING")), DISC, "site", eb=False)
    return model.unseen(c.where(F.col("yr") == YEAR2))


@query("H2_empirical_bayes")
def h2b(spark, d):
    v = visits(spark, d)
    model = H.fit_site_model(v, DISC, "site", ["age"])
    return model.apply(_complete(spark, d)).select("id", "yr", *DISC)


@query("H4_guarded", f"{PLAIN} select id, yr, true as harmonized from c")
def h4(spark, d):
    return H.harmonize_guarded(visits(spark, d), DISC, "site", ["age", "sex"]).select("id", "yr", "harmonized")


@query("H5_prepare_harmonized")
def h5(spark, d):
    return H.prepare_harmonized(visits(spark, d), DISC, "target", "site", ["age"], (50_000, 400_000), ["age", "sex"]).select("id", "yr", "target", *DISC, "harmonized")


@query("H6_paired_harmonized", f"{PLAIN} select a.id from c a join c b on a.id = b.id where a.yr = 1995 and b.yr = 1997")
def h6(spark, d):
    return H.paired_harmonized(visits(spark, d), "id", "yr", BASE, YEAR2, list(DISC), "site", ["age"], "target").select("id")


def _split_harmonized(spark, d):
    c = _complete(spark, d).withColumn("split", F.when(F.col("yr") <= 1997, "train").when(F.col("yr") <= 1999, "val").otherwise("test"))
    return H.harmonize_splits(c, DISC, "site", eb=False)[0]


@query("H7_harmonize_splits", f"{PLAIN}, t as (select * from c where yr <= 1997), s as (select site, count(*) n, avg(price_rh) m, var_samp(price_rh) v, var_pop(price_rh) vp from t group by site), g as (select avg(price_rh) m from t), p as (select sqrt(sum(n * vp) / sum(n)) sg from s) select id, yr, case when yr <= 1997 then 'train' when yr <= 1999 then 'val' else 'test' end as split, round((price_rh - s.m) / sqrt(v) * sg + g.m, 3) as price_rh from c join s using (site), g, p")
def h7(spark, d):
    return _split_harmonized(spark, d).select("id", "yr", "split", F.round("price_rh", 3).alias("price_rh"))


@query("H8_post_check", f"{PLAIN}, t as (select * from c where yr <= 1997), s as (select site, count(*) n, avg(qty_lh) m, var_samp(qty_lh) v, var_pop(qty_lh) vp from t group by site), g as (select avg(qty_lh) m from t), p as (select sqrt(sum(n * vp) / sum(n)) sg from s), h as (select case when yr <= 1997 then 'train' when yr <= 1999 then 'val' else 'test' end as split, (qty_lh - s.m) / sqrt(v) * sg + g.m x from c join s using (site), g, p) select split, count(*) - count(x) as nulls, round(min(x), 5) as min, round(max(x), 5) as max, round(stddev_pop(x), 5) as std from h group by split")
def h8(spark, d):
    out = H.post_check(_split_harmonized(spark, d), ["qty_lh"])
    return out.select("split", "nulls", *[F.round(c, 5).alias(c) for c in ("min", "max", "std")])


# --- K: models -------------------------------------------------------------------------------------


@query("K1_ols", "select site, 'age' as term, round(regr_slope(target, age), 6) as beta, round(regr_r2(target, age), 6) as r2, count(*) as n from visits group by site")
def k1(spark, d):
    fit = ols(visits(spark, d), "target", ["age"], ["site"])
    return fit.where("term = 'age'").select("site", "term", r6("beta"), r6("r2"), "n")


@query("K2_K3_linear_family")
def k2(spark, d):
    prepared = R.prepare(baseline_rows(spark, d), spec(weight_edges=(0.0, 150_000.0, 300_000.0, 1e9)))
    frame = prepared.frame()
    return G.pooled_r(R.fits(prepared, frame, ["linear", "ridge", "elastic_net"])).drop("target")


@query("K4_linear_svr")
def k4(spark, d):
    prepared = R.prepare(baseline_rows(spark, d), spec(folds=3))
    preds, _ = R.svr_predictions(prepared, prepared.frame())
    return preds


@query("K5_forest_regressor")
def k5(spark, d):
    prepared = R.prepare(baseline_rows(spark, d), spec(folds=3))
    return R.forest_predictions(prepared, prepared.frame())


def _two_folds(spark, d):
    rows = assign_folds(assemble(embedded(spark, d).withColumn("y", F.col("y").cast("double")), EMB), "vec_id", 4, ["y"])
    rows = stage(rows.select("vec_id", "y", "fold", "x"))
    return rows.where("fold <> 0"), rows.where("fold = 0")


def _one_fit(name, **params):
    def run(spark, d):
        train, test = _two_folds(spark, d)
        task = C.Task("vec_id", "y", EMB)
        return C.fit_score(name, train, test, task, params, ["vec_id", "y"])

    return run


query("K6_logistic")(_one_fit("logistic"))
query("K7_linear_svc")(_one_fit("svm"))
query("K9_forest_classifier")(_one_fit("random_forest"))
query("K10_mlp")(_one_fit("mlp"))


@query("K8_fourier_svc")
def k8(spark, d):
    # Written once: 64 array elements as real columns, not aliases the optimizer reasons about in every pass.
    wide = stage(embedded(spark, d).withColumn("y", F.col("y").cast("double")))
    rows = stage(assign_folds(wide, "vec_id", 4, ["y"])).withColumn("is_train", F.col("fold") != 0)
    task = C.Task("vec_id", "y", EMB, kernel="rbf")
    ready = stage(C.vectorize(rows, task).select("vec_id", "y", "is_train", "x"))
    return C.fit_score("svm", ready.where("is_train"), ready.where("not is_train"), task, {}, ["vec_id", "y"])


@query("K12_platt")
def k12(spark, d):
    train, test = _two_folds(spark, d)
    task = C.Task("vec_id", "y", EMB)
    inner = C.out_of_fold("svm", train, task, {}, "platt")
    return C.apply_platt(C.fit_score("svm", train, test, task, {}, ["vec_id", "y"]), C.fit_platt(inner))


@query("K13_grid_search")
def k13(spark, d):
    train, _ = _two_folds(spark, d)
    _, tried = C.tune("logistic", train, C.Task("vec_id", "y", EMB, grid={"C": [0.01, 0.1]}))
    rows = [(str(t["params"]), float(t["score"]), int(i)) for i, t in enumerate(tried)]
    return spark.createDataFrame(rows, "params string, score double, place int")


def emb_task(**over):
    return C.Task(**{**dict(id="vec_id", label="y", features=EMB, site="site", folds=3), **over})


@query("K14_K15_nested_classification")
def k15(spark, d):
    return C.nested_cv(embedded(spark, d), emb_task(), "svm")["metrics"]


@query("F9_balanced_ensemble")
def f9(spark, d):
    train, test = _two_folds(spark, d)
    task = C.Task("vec_id", "y", EMB, iterations=100)
    scores, _ = C.balanced_ensemble("logistic", train, test, task, {})
    return scores


@query("K13_K12_tuned_classification")
def k13c(spark, d):
    """Metrics of a support vector classifier whose setting is chosen in each outer fold, with calibrated scores."""
    return C.nested_cv(embedded(spark, d), emb_task(grid={"C": [0.01, 0.1, 1.0]}, calibrate=True), "svm")["metrics"]


@query("F9_nested_ensemble")
def f9b(spark, d):
    """Metrics of 100 fits on balanced subsets in every outer fold."""
    return C.nested_cv(embedded(spark, d), emb_task(iterations=100), "logistic")["metrics"]


@query("K16_K17_nested_regression")
def k17(spark, d):
    return R.nested_cv(baseline_rows(spark, d), spec())["metrics"]


# The settings that the study tries for each model.
GRID = {
    "ridge": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]},
    "elastic_net": {"alpha": [0.001, 0.01, 0.1, 1.0], "l1_ratio": [0.1, 0.5, 0.9]},
    "svr": {"C": [0.01, 0.1, 1.0, 10.0], "epsilon": [0.01, 0.05, 0.1, 0.2]},
}


@query("K13_tuned_regression")
def k13b(spark, d):
    """Metrics of all models with their settings chosen inside each outer fold, by mean absolute error."""
    return R.nested_cv(baseline_rows(spark, d), spec(), tuple(GRID), grid=GRID)["metrics"]


@query("K13_regression_choices")
def k13d(spark, d):
    """The settings that each outer fold chooses for the linear models, by correlation."""
    grid = {m: GRID[m] for m in ("ridge", "elastic_net")}
    return R.nested_cv(baseline_rows(spark, d), spec(), tuple(grid), grid=grid, scoring="pearson_r")["choices"]


@query("K18_cross_sectional_svc")
def k18(spark, d):
    rows = baseline_rows(spark, d).withColumn("y", (F.col("target") > 250_000).cast("int"))
    task = C.Task("id", "y", DISC, "site", ("age",), folds=3)
    return C.nested_cv(rows, task, "svm")["metrics"]


@query("K19_saved_folds_permuted")
def k19(spark, d):
    null, _ = R.permutation_null(baseline_rows(spark, d), spec(), 1000)
    return null


@query("K20_feature_sets")
def k20(spark, d):
    return R.compare_feature_sets(baseline_rows(spark, d), spec())


# --- M18 to M23: inference by refitting ------------------------------------------------------------


@query("M18_permutation_test")
def m18(spark, d):
    return R.permutation_null(baseline_rows(spark, d), spec(), 1000)[1]


def donor_sql(rows, perms, seed=42, tag="perm"):
    """Common table expressions: `dn` (perm, slot, donor) for the slots of `rows` (one row each, numbered from 0 in column slot)."""
    keys = ", ".join(f"('0x' || substr(md5('{seed}|{tag}|' || perm || '|{r}'), 1, 8))::bigint & 2147483647" for r in range(6))
    step = "list_reduce(list_prepend({v}, ks), lambda a, k: ((a & m) << h) | xor(a >> h, (((((a & m) + k) & 2147483647) * 1103515245) >> 15) & m))"
    return f"""
sz as (select count(*) n, greatest(1, ceil(length(case when count(*) > 1 then bin(count(*) - 1) else '' end) / 2.0))::bigint h from {rows}),
pk as (select perm, n, h, ((1::bigint << h) - 1)::bigint m, [{keys}] ks from range(0, {perms}) t(perm), sz),
wk(perm, slot, v, n, h, m, ks) as (
  select perm, slot, {step.format(v="slot")}, n, h, m, ks from pk, {rows}
  union all select perm, slot, {step.format(v="v")}, n, h, m, ks from wk where v >= n),
dn as (select perm, slot, v donor from wk where v < n)"""


@query("M18_shuffled_correlations", f"with recursive {VISITS_SQL.strip()}, " "bs as (select id, target, qty_lh, price_rh, row_number() over (order by md5(concat_ws('|', '42', 'order', id)), id) - 1 slot from visits where yr = 1995 and target is not null and qty_lh is not null and price_rh is not null), "
       + donor_sql("bs", 1000) + " select f feature, perm::int perm, round(corr(x, y), 6) r from (select perm, a.qty_lh, a.price_rh, b.target y from dn join bs a on a.slot = dn.slot join bs b on b.slot = dn.donor) unpivot (x for f in (qty_lh, price_rh)) group by f, perm", cohort=False)
def m18c(spark, d):
    """The null distribution of two features' correlations: 1,000 shuffles of the target."""
    base = visits(spark, d).where(F.col("yr") == BASE)
    return shuffled_correlations(base, "id", ["qty_lh", "price_rh"], "target", 1000).select("feature", "perm", r6("r"))


@query("M18_permutation_test_svr")
def m18b(spark, d):
    return R.permutation_null(baseline_rows(spark, d), spec(), 1000, "svr")[1]


@query("M19_sex_stratified")
def m19(spark, d):
    return B.by_group_cv(baseline_rows(spark, d), spec(), "sex")


@query("M19_sex_stratified_permutation")
def m19b(spark, d):
    return R.permutation_null(baseline_rows(spark, d), spec(covariates=("age",), residualize=("age",)), 1000, groups=["sex"])[1]


@query("M20_fold_permutation_bootstrap")
def m20(spark, d):
    rows = baseline_rows(spark, d)
    preds = R.nested_cv(rows, spec())["predictions"]
    p = R.permutation_null(rows, spec(), 1000, alternative="greater")[1].select("observed", "p")
    boot = V.bootstrap_regression(preds, "id", "y", "yhat", 10_000).where("metric = 'pearson_r'").select("lower", "upper")
    return boot.withColumns({"observed": p.select("observed").scalar(), "p": p.select("p").scalar()})


@query("M21_mean_gap", f"with recursive {VISITS_SQL.strip()}, g as (select id, target v, sex = '1' g, row_number() over (order by md5(concat_ws('|', '42', 'order', id)), id) - 1 slot from visits where yr = 1995 and target is not null), "
       + "n as (select avg(v) filter (where g) - avg(v) filter (where not g) gap from g), " + donor_sql("g", 1000, tag="gap")
       + ", nu as (select perm, avg(a.v) filter (where b.g) - avg(a.v) filter (where not b.g) gap from dn join g a on a.slot = dn.slot join g b on b.slot = dn.donor group by perm), "
       + f"bo as (select sum(w * v) filter (where g) / sum(w) filter (where g) - sum(w * v) filter (where not g) / sum(w) filter (where not g) gap from {poisson_sql('g', 'id', 10000)} group by b) "
       + "select round((select gap from n), 4) as gap, round((1 + count(*) filter (where abs(nu.gap) >= abs((select gap from n)))) / (1 + count(*)), 6) as p, "
       + "(select round(quantile_cont(gap, 0.025), 4) from bo) as lower, (select round(quantile_cont(gap, 0.975), 4) from bo) as upper from nu", cohort=False)
def m21(spark, d):
    base = visits(spark, d).where(F.col("yr") == BASE)
    return N.mean_gap(base, "id", F.col("sex") == "1", "target", 1000, 10_000).select(*[F.round(c, 4).alias(c) for c in ("gap", "lower", "upper")], r6("p"))


@query("M23_permutation_importance")
def m23(spark, d):
    prepared = R.prepare(baseline_rows(spark, d), spec())
    frame = prepared.frame()
    return R.permutation_importance(prepared, frame, R.fits(prepared, frame), repeats=2)


@query("M23_classifier_importance")
def m23b(spark, d):
    rows = baseline_rows(spark, d).dropna("any", subset=list(DISC)).select("id", (F.col("target") > 250_000).cast("double").alias("y"), *DISC)
    scaled = stage(W.apply_scaler(rows, W.fit_scaler(rows, DISC), DISC))
    model = classifier("logistic", len(DISC), float(scaled.count()), C=1.0).fit(assemble(scaled, DISC))
    return C.permutation_importance(scaled, model, list(DISC), "id", repeats=2)


@query("M24_residual_terms")
def m24(spark, d):
    prepared = R.prepare(baseline_rows(spark, d), spec())
    return V.residual_report(G.residual_terms(R.fits(prepared, prepared.frame()), prepared.resid))


# --- N: longitudinal -------------------------------------------------------------------------------

LONG = "ok as (select * from visits where yr in (1995, 1997, 1998, 1999) and qc <= 6), ids as (select id from ok group by id having count(*) filter (where yr = 1995) > 0 and count(*) filter (where yr <> 1995) > 0), lo as (select * from ok where id in (select id from ids))"
WIDE = LONG + ", wi as (select id, " + ", ".join(f"max(case when yr = {y} then target end) target_{n}" for n, y in VISITS.items()) + ", max(case when yr = 1995 then age end) age from lo group by id)"


def _long_wide(spark, d):
    return N.load_longitudinal(visits(spark, d), "id", "yr", "target", VISITS, "qc", 6, "sex", {1: "male", 2: "female"}, carry=["qty_lh"])


@query("N1_load_longitudinal", f"{LONG} select id, yr, case yr when 1995 then 0 when 1997 then 1 when 1998 then 2 else 3 end as tp_idx, last_value(qty_lh ignore nulls) over (partition by id order by yr rows between unbounded preceding and current row) as qty_lh from lo")
def n1(spark, d):
    return _long_wide(spark, d)[0].select("id", "yr", "tp_idx", "qty_lh")


@query("N2_change_scores", f"{WIDE} select id, round(target_year2 - target_baseline, 4) as delta_target, cast(target_year2 > target_baseline as int) as worsened from wi where target_year2 is not null and target_baseline is not null")
def n2(spark, d):
    return N.change_scores(_long_wide(spark, d)[1], "target").select("id", F.round("delta_target", 4).alias("delta_target"), "worsened")


@query("N3_worsening_cohort", f"{WIDE}, th as (select 0.5 * stddev_samp(target_baseline) t from wi where target_baseline is not null) select id, cast(target_year2 - target_baseline >= t as int) as worsened from wi, th where target_year2 is not null and target_baseline is not null")
def n3(spark, d):
    return N.worsening_cohort(_long_wide(spark, d)[1], "target").select("id", "worsened")


@query("N4_worsening_groups")
def n4(spark, d):
    rows = N.worsening_cohort(_long_wide(spark, d)[1], "target")
    return N.worsening_groups(rows, FEATURES, PAIRS, "worsened", "site", ["age"])


@query(
    "N5_attrition_tests",
    "b as (select id, age, sex, target, id in (select id from visits where yr = 1997 and target is not null) k from visits where yr = 1995), m as (" + " union all ".join(
        f"select '{c}' measure, count({c}) filter (where k) n1, count({c}) filter (where not k) n2, avg({c}) filter (where k) m1, avg({c}) filter (where not k) m2, var_samp({c}) filter (where k) v1, var_samp({c}) filter (where not k) v2 from b" for c in ("age", "target")
    ) + "), t as (select cast(count(*) filter (where k and sex='1') as double) a, cast(count(*) filter (where k and sex='2') as double) b, cast(count(*) filter (where not k and sex='1') as double) c, cast(count(*) filter (where not k and sex='2') as double) d from b) select measure, n1, n2, round((m1-m2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1/n1+1/n2)), 5) as statistic from m union all select 'sex', cast(a+b as bigint), cast(c+d as bigint), round(chi2, 5) from (select *, " + CHI + " from t)",
)
def n5(spark, d):
    return N.attrition_tests(visits(spark, d), "id", "yr", BASE, YEAR2, "target", "age", "sex", "1", "2").select("measure", "n1", "n2", F.round("statistic", 5).alias("statistic"))


@query("N6_change_correlations", f"{AI_CTE}, p as (select " + ", ".join(f"b.{n}_AI - a.{n}_AI as {n}" for n, _, _ in PAIRS) + ", b.target - a.target t from ai a join ai b on a.id = b.id where a.yr = 1995 and b.yr = 1997) " + corr_sql([n for n, _, _ in PAIRS], "t", "p", min_n=10).replace("as feature", "as structure"))
def n6(spark, d):
    return N.change_correlations(visits(spark, d), "id", "yr", BASE, YEAR2, PAIRS, "target").select("structure", r6("r"), "n")


@query(
    "N7_icc",
    f"{AI_CTE}, " + "w as (" + " union all ".join(f"select '{c}' structure, id, max(case when yr=1995 then {c} end) a, max(case when yr=1997 then {c} end) b, max(case when yr=1998 then {c} end) c from ai group by id" for c in AI) + "), x as (select * from w where a is not null and b is not null and c is not null), l as (select structure, id, unnest([a, b, c]) v, unnest([1, 2, 3]) k from x), g as (select structure, avg(v) gm, count(distinct id) n from l group by 1), rs as (select structure, sum(3 * (m - gm) * (m - gm)) s from (select structure, id, avg(v) m from l group by 1, 2) join g using (structure) group by 1), cs as (select structure, sum(n * (m - gm) * (m - gm)) s from (select structure, k, avg(v) m from l group by 1, 2) join g using (structure) group by 1), ts as (select structure, sum((v - gm) * (v - gm)) s from l join g using (structure) group by 1), ms as (select structure, n, rs.s / (n - 1) msr, (ts.s - rs.s - cs.s) / ((n - 1) * 2) mse from g join rs using (structure) join cs using (structure) join ts using (structure)) select structure, n, round((msr - mse) / (msr + 2 * mse), 6) as icc, round(msr / mse, 5) as f from ms where n >= 10",
)
def n7(spark, d):
    return N.icc(cohort_ai(spark, d), "id", "yr", [BASE, YEAR2, 1998], AI).select("structure", "n", r6("icc"), F.round("f", 5).alias("f"))


@query("N8_stability")
def n8(spark, d):
    rows = visits(spark, d).where(F.col("yr").isin(list(VISITS.values())))
    return N.stability(rows, "yr", FEATURES, PAIRS, "target", "site", ["age"], min_severity=50_000)[1]


@query("N9_cross_visit_prediction")
def n9(spark, d):
    rows = visits(spark, d).where(F.col("sex").isin("1", "2"))
    return N.predict_across(rows, spec(), "yr", BASE, YEAR2, (50_000, 400_000))["metrics"]


@query("N10_persistent_remitted", f"{AI_CTE}, g as (select a.*, case when b.target >= 200000 then 'p' else 'r' end k from ai a join visits b on a.id = b.id and b.yr = 1997 where a.yr = 1995 and a.target >= 200000), " + t_sql(AI, "k = 'p'", "k = 'r'", "g", True))
def n10(spark, d):
    from varve.operators.joins import wide_assembly

    wide = wide_assembly(visits(spark, d), "id", "yr", "target", VISITS, FEATURES)
    return t_cols(N.persistent_remitted(wide, "target", PAIRS, 200_000))


@query("N11_replication_cohorts", f"{WIDE}, la as (select * from lo where yr = 1997), th as (select 0.5 * stddev_samp(target_baseline) t from wi where target_baseline is not null) select 'baseline_defined' as cohort, id from la where id in (select id from lo where yr = 1995 and target >= 200000) union all select 'follow_up_defined', id from la where target >= 200000 union all select 'worseners', id from la where id in (select id from wi, th where target_year2 - target_baseline >= t)")
def n11(spark, d):
    long, wide = _long_wide(spark, d)
    return N.replication_cohorts(long, wide, "id", "yr", BASE, YEAR2, "target", 200_000).select("cohort", "id")


@query("N11_replicate")
def n11b(spark, d):
    long, wide = _long_wide(spark, d)
    return N.replicate(N.replication_cohorts(long, wide, "id", "yr", BASE, YEAR2, "target", 200_000), PAIRS, "target")


@query("N12_prospective")
def n12(spark, d):
    rows = visits(spark, d).where(F.col("sex").isin("1", "2"))
    return N.prospective(rows, spec(residualize=("age",)), "yr", BASE, YEAR2, perms=1000, draws=10_000)["bootstrap"]


@query("N13_delta_model")
def n13(spark, d):
    wide = _long_wide(spark, d)[1].where(F.col("sex").isin("1", "2"))
    return N.delta_model(wide, spec())["metrics"]


@query("N13_worsening_classifiers")
def n13b(spark, d):
    wide = _long_wide(spark, d)[1]
    task = C.Task("id", "worsened", DISC, "site", ("age",), folds=2, inner_folds=2)
    return N.worsening_classifiers(wide, "target", task, ("svm",))


@query("N14_visit_asymmetry", f"{AI_CTE} select id, " + ", ".join(f"round({c}, 6) as {c}" for c in AI) + " from ai where yr = 1997")
def n14(spark, d):
    return N.visit_asymmetry(visits(spark, d), "id", "yr", YEAR2, PAIRS).select("id", *[r6(c) for c in AI])


@query("N14_asymmetry_winner", f"{AI_CTE.replace('from visits)', 'from visits where yr = 1997)')}, {VERSUS} select structure, case when abs(r_ai) > abs(r_total) then 'asymmetry' else 'total' end as winner, {MENG} from c")
def n14b(spark, d):
    return N.asymmetry_winner(visits(spark, d), "yr", YEAR2, PAIRS, "target").select("structure", "winner", F.round("z", 5).alias("z"))


@query("N14_symptom_trajectory", "p as (select b.target - a.target x from visits a join visits b on a.id = b.id where a.yr = 1995 and b.yr = 1997) select count(x) as n, round(avg(x), 4) as mean_change, round(avg(x) * sqrt(count(x)) / stddev_samp(x), 5) as t from p")
def n14c(spark, d):
    return A.paired_t(visits(spark, d), "id", "yr", BASE, YEAR2, ["target"]).select("n", F.round("mean_change", 4).alias("mean_change"), F.round("t", 5).alias("t"))


@query("N15_severity_trajectories", f"{AI_CTE} select case when a.target < 100000 then 'none' when a.target < 300000 then 'some' else 'high' end as severity, count(*) as n, round(avg(a.qty_AI), 6) as first, round(avg(b.qty_AI), 6) as second, round(avg(b.qty_AI - a.qty_AI), 6) as delta from ai a join ai b on a.id = b.id where a.yr = 1995 and b.yr = 1997 group by 1")
def n15(spark, d):
    v = visits(spark, d).select("id", "yr", "target", asymmetry(F.col("qty_lh"), F.col("qty_rh")).alias("ai"))
    return N.severity_trajectories(v, "id", "yr", BASE, YEAR2, "target", "ai", (100_000, 300_000)).select("severity", "n", *[r6(c) for c in ("first", "second", "delta")])


# --- R: robustness ---------------------------------------------------------------------------------

CUT = tuple(range(0, 325_000, 25_000))


@query("R1_cutoff_sweep", f"{AI_CTE}, cu as (select unnest({list(CUT)}) c) " + " union all ".join(f"select cast(c as double) as cutoff, '{f}' as feature, round(corr({f}, target), 6) as r, count({f}) as n from ai, cu where target >= c group by c having count({f}) >= 50" for f in AI))
def r1(spark, d):
    return B.cutoff_sweep(cohort_ai(spark, d), AI, "target", CUT).select("cutoff", "feature", r6("r"), "n")


@query("R2_split_halves")
def r2(spark, d):
    return B.split_halves(baseline_rows(spark, d), spec(), 100)[0]


@query("R3_leave_one_out")
def r3(spark, d):
    return B.leave_one_out(baseline_rows(spark, d), spec())


@query("R3_leave_one_out_svr")
def r3b(spark, d):
    return B.leave_one_out(baseline_rows(spark, d), spec(), "svr")


POOL = "select p_brand as feature, corr(p_size, p_retailprice) r from part group by 1"


@query("R4_network_null", f"with c as ({POOL}), k as (select cast(dr as int) as draw, feature, r, row_number() over (partition by dr order by md5(concat_ws('|', '42', 'draw', feature, dr)), feature) rn from c, range(0, 50) t(dr)) select draw, feature, round(r, 6) as r from k where rn <= 5 qualify row_number() over (partition by draw order by abs(r) desc, feature) = 1", cohort=False)
def r4(spark, d):
    pool = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(A.pearson(F.col("p_size"), F.col("p_retailprice")).alias("r"))
    return B.network_null(pool, 50, 5).select("draw", "feature", r6("r"))


@query("R4_named_networks")
def r4b(spark, d):
    return B.compare_networks(baseline_rows(spark, d), spec(), {"quantity": ("qty_lh", "qty_rh"), "price": ("price_lh", "price_rh"), "both": DISC})


@query("R5_sex_stratified", f"{AI_CTE} " + corr_sql(AI, "target", "ai", "sex", 30))
def r5(spark, d):
    return B.stratified_correlations(visits(spark, d), "sex", PAIRS, "target", 30).select("sex", "feature", r6("r"), "n")


@query("R6_site_stratified", f"{AI_CTE} " + corr_sql(AI, "target", "ai", "site", 20))
def r6q(spark, d):
    return B.stratified_correlations(visits(spark, d), "site", PAIRS, "target", 20).select("site", "feature", r6("r"), "n")


@query("R5_sex_stratified_harmonized")
def r5b(spark, d):
    return B.stratified_correlations(visits(spark, d), "sex", PAIRS, "target", 30, "site", ["age"])


@query("R7_one_per_family")
def r7(spark, d):
    return B.one_per_family(baseline_rows(spark, d), spec(), 100)[0]


@query("R8_alternative_targets")
def r8(spark, d):
    return B.alternative_targets(baseline_rows(spark, d), spec(), {"total": ("target", None), "cut": ("target", (100_000, 400_000)), "disc": ("disc_lh", None)})

