"""Longitudinal studies: change, attrition, reliability, replication and prediction across visits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions import effects as X
from varve.functions.pvalues import chi2_pvalue, f_ppf, f_pvalue, t_pvalue
from varve.functions.scalars import asymmetry, asymmetry_columns, value_map
from varve.models import classification as C
from varve.models import regression as R
from varve.operators import association as A
from varve.operators import joins as J
from varve.operators.combat import harmonize_guarded, paired_harmonized
from varve.operators.missing import forward_fill
from varve.operators.prep import complete, quality_control
from varve.operators.shape import best_signed, melt
from varve.session import stage, stage_small


def load_longitudinal(
    df: DataFrame, id_col, timepoint, target, visits: dict, qc=None, qc_max=None, sex=None, sex_map=None, carry=()
) -> tuple[DataFrame, DataFrame]:
    """(long, wide): QC-passing scored visits of subjects with a baseline and at least one follow-up.

    Covariates collected at baseline are carried forward; the wide table has one score column per visit.
    """
    names = list(visits)
    baseline = visits[names[0]]
    rows = df.where(F.col(timepoint).isin(list(visits.values())) & F.col(target).isNotNull())
    if sex and sex_map:
        rows = rows.withColumn("sex_mapped", value_map(F.col(sex), sex_map))
    if qc:
        rows = quality_control(rows, [id_col, timepoint], qc, qc_max)[0].where("qc_pass")
    at_base = F.col(timepoint) == baseline
    ids = rows.groupBy(id_col).agg(F.count_if(at_base).alias("_a"), F.count_if(~at_base).alias("_b")).where("_a > 0 and _b > 0").select(id_col)
    long = rows.join(ids, id_col, "left_semi").withColumn("tp_idx", J.visit_index(F.col(timepoint), list(visits.values())))
    if carry:
        long = forward_fill(long, id_col, "tp_idx", list(carry))
    extra = [c for c in long.columns if c not in {id_col, timepoint, target, "tp_idx", "qc_pass", "qc_reason"}]
    return long, J.wide_assembly(long, id_col, timepoint, target, visits, extra)


def change_scores(wide: DataFrame, target: str, first="baseline", second="year2", threshold=None) -> DataFrame:
    """Change of the score; worsened when it rises, or reaches the threshold."""
    a, b = F.col(f"{target}_{first}"), F.col(f"{target}_{second}")
    out = wide.where(a.isNotNull() & b.isNotNull()).withColumn("delta_target", b - a)
    delta = F.col("delta_target")
    return out.withColumn("worsened", ((delta > 0) if threshold is None else (delta >= threshold)).cast("int"))


def worsening_threshold(df: DataFrame, target: str, factor=0.5, round_up=False) -> Column:
    """factor x SD of the score over all baseline rows, as a scalar of the plan."""
    sd = F.stddev_samp(target) * factor
    return df.agg((F.ceil(sd).cast("double") if round_up else sd).alias("t")).scalar()


def worsening_cohort(wide: DataFrame, target: str, first="baseline", second="year2", factor=0.5, round_up=False) -> DataFrame:
    base = wide.where(F.col(f"{target}_{first}").isNotNull())
    return change_scores(wide, target, first, second, worsening_threshold(base, f"{target}_{first}", factor, round_up))


def worsening_groups(df: DataFrame, features, pairs, worsened: str, site: str, covariates=()) -> DataFrame:
    """Worseners against stable subjects per asymmetry feature, after harmonization."""
    ready = harmonize_guarded(df, features, site, covariates)
    ai = ready.select(worsened, *asymmetry_columns(pairs, total=False))
    return A.t_tests(ai, [f"{n}_AI" for n, _, _ in pairs], F.col(worsened) == 1, F.col(worsened) == 0)


def attrition_tests(df: DataFrame, id_col, timepoint, baseline, follow_up, target, age, sex, male="male", female="female", min_n=5) -> DataFrame:
    """Retained against lost on age, severity (t) and sex (chi-square with correction): (measure, statistic, p, n...)."""
    flags = stage(J.retained(df, id_col, timepoint, baseline, follow_up, target, [age, sex, target]))
    kept = F.col("retained")
    m = A.two_groups(flags, [age, target], kept, ~kept).where((F.col("n1") > min_n) & (F.col("n2") > min_n))
    n1, m1, v1, n2, m2, v2 = (F.col(c) for c in ("n1", "mean1", "var1", "n2", "mean2", "var2"))
    t = m.select(F.col("feature").alias("measure"), "n1", "n2", X.pooled_t(n1, m1, v1, n2, m2, v2).alias("statistic"))
    t = t.withColumn("p", t_pvalue("statistic", F.col("n1") + F.col("n2") - 2.0))
    known = flags.where(F.col(sex).isin(male, female))
    cells = known.agg(
        F.count_if(kept & (F.col(sex) == male)).alias("a"), F.count_if(kept & (F.col(sex) == female)).alias("b"),
        F.count_if(~kept & (F.col(sex) == male)).alias("c"), F.count_if(~kept & (F.col(sex) == female)).alias("d"),
    )
    chi = cells.select(
        F.lit("sex").alias("measure"), (F.col("a") + F.col("b")).alias("n1"), (F.col("c") + F.col("d")).alias("n2"),
        X.yates_chi2(*[F.col(c).cast("double") for c in "abcd"]).alias("statistic"),
    ).withColumn("p", chi2_pvalue("statistic", F.lit(1.0)))
    return t.unionByName(chi)


def change_correlations(df: DataFrame, id_col, timepoint, first, second, pairs, target, site=None, covariates=(), min_n=10) -> DataFrame:
    """Correlation of the change in asymmetry with the change in score per structure."""
    features = list(dict.fromkeys(c for _, l, r in pairs for c in (l, r)))
    if site:
        both = paired_harmonized(df, id_col, timepoint, first, second, features, site, covariates, target)
    else:
        both = J.paired(df, id_col, timepoint, first, second, [*features, target])
    cols = [
        (asymmetry(F.col(f"{l}_2"), F.col(f"{r}_2")) - asymmetry(F.col(f"{l}_1"), F.col(f"{r}_1"))).alias(n) for n, l, r in pairs
    ]
    deltas = both.select((F.col(f"{target}_2") - F.col(f"{target}_1")).alias("_d"), *cols)
    out = A.correlations(deltas, [n for n, _, _ in pairs], "_d", min_n=min_n).withColumnRenamed("feature", "structure")
    return out.withColumn("p", t_pvalue(X.r_to_t(F.col("r"), F.col("n")), F.col("n") - 2.0))


def icc(df: DataFrame, id_col, timepoint, visits, values, min_n=10, level=0.95) -> DataFrame:
    """ICC(3,1) of each value over subjects seen at every visit: two-way mean squares, F interval and p."""
    visits = list(visits)
    k = float(len(visits))
    tall = melt(df.where(F.col(timepoint).isin(visits)), [id_col, timepoint], values).where(F.col("value").isNotNull())
    centre = stage_small(tall.groupBy("feature").agg(F.avg("value").alias("_m")))
    tall = tall.join(centre, "feature").withColumn("value", F.col("value") - F.col("_m"))
    at = [F.max(F.when(F.col(timepoint) == v, F.col("value"))).alias(f"v{i}") for i, v in enumerate(visits)]
    wide = tall.groupBy("feature", id_col).agg(*at).where(complete([f"v{i}" for i in range(len(visits))]))
    v = [F.col(f"v{i}") for i in range(len(visits))]
    row_sum = sum(v[1:], v[0])
    sums = wide.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum(sum((x * x for x in v[1:]), v[0] * v[0])).alias("ss"), F.sum(row_sum * row_sum).alias("rr"),
        F.sum(row_sum).alias("g"), *[F.sum(x).alias(f"c{i}") for i, x in enumerate(v)],
    )
    n = F.col("n").cast("double")
    correction = F.col("g") * F.col("g") / (n * k)
    rows_ss = F.col("rr") / k - correction
    cols_ss = sum((F.col(f"c{i}") * F.col(f"c{i}") for i in range(1, len(visits))), F.col("c0") * F.col("c0")) / n - correction
    ms = sums.where(F.col("n") >= min_n).select(
        F.col("feature").alias("structure"), "n", (rows_ss / (n - 1)).alias("msr"),
        ((F.col("ss") - correction - rows_ss - cols_ss) / ((n - 1) * (k - 1))).alias("mse"),
    )
    f = F.try_divide(F.col("msr"), F.col("mse"))
    d1, d2 = n - 1, (n - 1) * (k - 1)
    a = (1 - level) / 2
    out = ms.withColumns({"icc": F.try_divide(F.col("msr") - F.col("mse"), F.col("msr") + (k - 1) * F.col("mse")), "f": f, "_d1": d1, "_d2": d2})
    out = out.withColumns({"p": f_pvalue("f", "_d1", "_d2"), "_lo": f_ppf(F.lit(1 - a), "_d1", "_d2"), "_hi": f_ppf(F.lit(1 - a), "_d2", "_d1")})
    low, high = F.col("f") / F.col("_lo"), F.col("f") * F.col("_hi")
    return out.withColumns({"lower": (low - 1) / (low + k - 1), "upper": (high - 1) / (high + k - 1)}).drop("_d1", "_d2", "_lo", "_hi")


def stability(df: DataFrame, timepoint, features, pairs, target, site=None, covariates=(), min_severity=None, min_n=30) -> tuple[DataFrame, DataFrame]:
    """Asymmetry-score correlations per visit, harmonized within the visit, and the best feature of each visit."""
    from varve.operators.combat import _numeric, fit_site_model

    rows = df.where(F.col(target).isNotNull())
    if min_severity is not None:
        rows = rows.where(F.col(target) >= min_severity)
    if site:
        rows, names = _numeric(rows.where(complete([*features, site, *covariates])), list(covariates))
        rows = fit_site_model(rows, features, site, names, groups=[timepoint]).apply(rows)
    ai = rows.select(timepoint, target, *asymmetry_columns(pairs, total=False))
    table = A.correlations(ai, [f"{n}_AI" for n, _, _ in pairs], target, [timepoint])
    table = table.withColumn("r", F.when(F.col("n") >= min_n, F.col("r")))
    return table, best_signed(table, [timepoint], "feature", "r")


def cross_visit(df: DataFrame, spec: R.Spec, timepoint, baseline, follow_up, score_range=None) -> DataFrame:
    """Rows for predicting the follow-up score from baseline features: target replaced by the later score."""
    rows = df
    if score_range is not None:
        rows = rows.where((F.col(timepoint) != baseline) | ((F.col(spec.target) >= score_range[0]) & (F.col(spec.target) < score_range[1])))
    joined = J.with_follow_up(rows, spec.id, timepoint, baseline, follow_up, spec.target, "_later")
    return joined.withColumn(f"{spec.target}_baseline", F.col(spec.target)).withColumn(spec.target, F.col("_later")).drop("_later")


def predict_across(df: DataFrame, spec: R.Spec, timepoint, baseline, follow_up, score_range=None, models=("ridge",), svr=False):
    """Nested CV of the follow-up score on baseline features."""
    return R.nested_cv(cross_visit(df, spec, timepoint, baseline, follow_up, score_range), spec, models, svr)


def prospective(df: DataFrame, spec: R.Spec, timepoint, baseline, follow_up, perms=20, draws=200, model="ridge") -> dict[str, DataFrame]:
    """Follow-up score with the baseline score residualized away, its permutation p and bootstrap interval."""
    from varve.operators.evaluation import bootstrap_regression

    rows = stage(cross_visit(df, spec, timepoint, baseline, follow_up))
    aware = replace(spec, residualize=(*spec.residualize, f"{spec.target}_baseline"))
    result = R.nested_cv(rows, aware, () if model == "svr" else (model,), model == "svr")
    null, p = R.permutation_null(rows, aware, perms, model, alternative="greater")
    boot = bootstrap_regression(result["predictions"], [spec.id], "y", "yhat", draws)
    return {**result, "null": null, "p": p, "bootstrap": boot}


def delta_model(wide: DataFrame, spec: R.Spec, first="baseline", second="year2", models=("ridge",), svr=False) -> dict[str, DataFrame]:
    """Nested CV of the change score on baseline features."""
    rows = change_scores(wide, spec.target, first, second).withColumn("_delta", F.col("delta_target"))
    return R.nested_cv(rows, replace(spec, target="_delta", score_range=None), models, svr)


def worsening_classifiers(wide: DataFrame, target: str, task: C.Task, models=("svm",), first="baseline", second="year2", factor=0.5) -> DataFrame:
    """Pooled metrics of each classifier on the worsening label over identical folds."""
    rows = stage(worsening_cohort(wide, target, first, second, factor))
    task = replace(task, label="worsened")
    out = None
    for name in models:
        part = C.nested_cv(rows, task, name)["metrics"].withColumn("classifier", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def outcome_groups(wide: DataFrame, target: str, high: float, first="baseline", second="year2") -> Column:
    """persistent / remitted among subjects high at baseline, by the follow-up score."""
    a, b = F.col(f"{target}_{first}"), F.col(f"{target}_{second}")
    return F.when((a >= high) & (b >= high), "persistent").when((a >= high) & (b < high), "remitted")


def persistent_remitted(wide: DataFrame, target: str, pairs, high: float, site=None, covariates=(), first="baseline", second="year2") -> DataFrame:
    rows = wide.withColumn("_g", outcome_groups(wide, target, high, first, second)).where(F.col("_g").isNotNull())
    if site:
        rows = harmonize_guarded(rows, list(dict.fromkeys(c for _, l, r in pairs for c in (l, r))), site, covariates)
    ai = rows.select("_g", *asymmetry_columns(pairs, total=False))
    return A.t_tests(ai, [f"{n}_AI" for n, _, _ in pairs], F.col("_g") == "persistent", F.col("_g") == "remitted", welch=True)


def replication_cohorts(df: DataFrame, wide: DataFrame, id_col, timepoint, baseline, follow_up, target, high, factor=0.5) -> DataFrame:
    """Follow-up rows tagged by cohort: high at baseline, high at follow-up, and worseners."""
    later = df.where(F.col(timepoint) == follow_up)
    base_high = df.where((F.col(timepoint) == baseline) & (F.col(target) >= high)).select(id_col)
    worse = worsening_cohort(wide, target, factor=factor).where("worsened = 1").select(id_col)
    return J.union_all(
        {
            "baseline_defined": later.join(base_high, id_col, "left_semi"),
            "follow_up_defined": later.where(F.col(target) >= high),
            "worseners": later.join(worse, id_col, "left_semi"),
        },
        "cohort",
    )


def replicate(cohorts: DataFrame, pairs, target: str) -> DataFrame:
    """Asymmetry-score correlations per replication cohort."""
    ai = cohorts.select("cohort", target, *asymmetry_columns(pairs, total=False))
    return A.correlation_tests(ai, [f"{n}_AI" for n, _, _ in pairs], target, ["cohort"])


def visit_asymmetry(df: DataFrame, id_col, timepoint, visit, pairs, site=None, covariates=()) -> DataFrame:
    """Asymmetry of one visit, harmonized when a site is given."""
    rows = df.where(F.col(timepoint) == visit)
    if site:
        rows = harmonize_guarded(rows, list(dict.fromkeys(c for _, l, r in pairs for c in (l, r))), site, covariates)
    return rows.select(id_col, *asymmetry_columns(pairs, total=False))


def asymmetry_winner(df: DataFrame, timepoint, visit, pairs, target) -> DataFrame:
    """Which of asymmetry and total correlates more strongly with the score at a visit, per structure."""
    out = A.asymmetry_versus_total(df.where(F.col(timepoint) == visit), pairs, target)
    return out.withColumn("winner", F.when(F.abs("r_ai") > F.abs("r_total"), "asymmetry").otherwise("total"))


def severity_trajectories(df: DataFrame, id_col, timepoint, first, second, target, value, edges=(1, 30)) -> DataFrame:
    """Mean value at both visits and its change, by baseline severity (none / some / high)."""
    both = J.paired(df, id_col, timepoint, first, second, [target, value])
    score = F.col(f"{target}_1")
    level = F.when(score < edges[0], "none").when(score < edges[1], "some").otherwise("high")
    return both.where(score.isNotNull()).groupBy(level.alias("severity")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(f"{value}_1").alias("first"), F.avg(f"{value}_2").alias("second"),
        F.avg(F.col(f"{value}_2") - F.col(f"{value}_1")).alias("delta"),
    )


def mean_gap(df: DataFrame, id_col, group: Column, value: str, perms: int, draws: int, seed=42, level=0.95) -> DataFrame:
    """Gap of group means with a label-permutation p and a bootstrap interval.

    A permutation shuffles the labels over the rows by a bijection of their numbers; sums for all permutations, and for all draws of the
    bootstrap, are one matrix product per Arrow batch.
    """
    from varve.models.gram import Moments, gram
    from varve.operators.bootstrap import draw_sums
    from varve.operators.shuffles import number_rows, shuffled_targets

    rows = df.where(group.isNotNull() & F.col(value).isNotNull()).select(id_col, F.col(value).cast("double").alias("_v"), group.cast("boolean").alias("_g"))
    seen = rows.agg(
        F.count_if("_g").alias("n1"), F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"),
        (F.avg(F.when(F.col("_g"), F.col("_v"))) - F.avg(F.when(~F.col("_g"), F.col("_v")))).alias("gap"),
    ).first()
    numbered, block = shuffled_targets(number_rows(rows.withColumn("_g", F.col("_g").cast("double")), id_col, (), seed), "_g", perms, seed, "gap")

    def gaps_of(pdf):
        import pandas as pd

        first = Moments.read(pdf, 2, 2 + perms).xy[1]
        return pd.DataFrame({"gap": first / seen["n1"] - (seen["total"] - first) / (seen["n"] - seen["n1"])})

    null = gram(numbered, ["_v"], [], [], block=block).withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(gaps_of, "gap double")
    p = null.agg(((1 + F.count_if(F.abs("gap") >= abs(seen["gap"]))) / (1 + F.count("gap"))).alias("p"))
    one = F.col("_g").cast("double")
    boot = draw_sums(rows, id_col, {"n1": one, "s1": one * F.col("_v"), "n0": 1 - one, "s0": (1 - one) * F.col("_v")}, draws, seed)
    gaps = boot.select((F.try_divide("s1", "n1") - F.try_divide("s0", "n0")).alias("gap"))
    a = (1 - level) / 2
    ends = gaps.agg(F.percentile("gap", F.lit(a)).alias("lower"), F.percentile("gap", F.lit(1 - a)).alias("upper"))
    return ends.withColumns({"gap": F.lit(seen["gap"]), "p": p.scalar()})


