"""Correlations, group differences and multiple testing. One aggregate each; p-values on result rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from varve.functions import effects as X
from varve.functions.pvalues import chi2_pvalue, t_pvalue, z_pvalue
from varve.functions.scalars import asymmetry, clip
from varve.operators.joins import paired
from varve.operators.ols import ols
from varve.operators.ordering import average_ranks, order_stats, running_min, running_sums
from varve.operators.pair_tiles import CORRELATION, INTERACTION, pair_tiles, solve_correlations, solve_interactions
from varve.operators.shape import melt
from varve.session import stage


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; null when either side is constant or under two pairs are left."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.when((F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys)), F.corr(xs, ys))


def pairs_n(x: Column, y: Column) -> Column:
    return F.count_if(x.isNotNull() & y.isNotNull())


def adjust(df: DataFrame, p: str, groups=(), suffix="") -> DataFrame:
    """Bonferroni and Benjamini-Hochberg columns over the non-null p-values of each group.

    For result tables (one row per test). Range frames give tied p-values the same, largest rank.
    """
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    upto = whole.orderBy(F.col(p).asc_nulls_last()).rangeBetween(W.unboundedPreceding, W.currentRow)
    above = whole.orderBy(F.col(p).desc_nulls_first()).rangeBetween(W.unboundedPreceding, W.currentRow)
    m, known = F.count(p).over(whole), F.col(p).isNotNull()
    stepped = df.withColumn("_step", F.when(known, F.col(p) * m / F.count(p).over(upto)))
    return stepped.withColumns(
        {
            f"p_bonferroni{suffix}": F.when(known, F.least(F.col(p) * m, F.lit(1.0))),
            f"p_fdr{suffix}": F.when(known, F.least(F.min("_step").over(above), F.lit(1.0))),
        }
    ).drop("_step")


def adjust_many(df: DataFrame, p: str, groups=(), suffix="") -> DataFrame:
    """`adjust` for a table of p-values as long as the data: no window over a whole group.

    Equal p-values are collapsed, counted up and minimised down in value buckets, and joined back.
    """
    groups = list(groups)
    counts = stage(df.where(F.col(p).isNotNull()).groupBy(*groups, p).agg(F.count(F.lit(1)).alias("_m")))
    upto = running_sums(counts, p, ["_m"], groups)
    stepped = stage(upto.select(*groups, p, "tot__m", (F.col(p) * F.col("tot__m") / F.col("cum__m")).alias("_step")))
    lowest = running_min(stepped, p, "_step", groups, descending=True, out="_low")
    terms = lowest.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col(p).alias("_p"), F.col("tot__m").alias("_tot"), "_low")
    same = F.col(p) == F.col("_p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = df.join(terms, same, "left")
    return joined.withColumns(
        {
            f"p_bonferroni{suffix}": F.when(F.col("_p").isNotNull(), F.least(F.col(p) * F.col("_tot"), F.lit(1.0))),
            f"p_fdr{suffix}": F.when(F.col("_p").isNotNull(), F.least("_low", F.lit(1.0))),
        }
    ).drop("_p", "_tot", "_low", *[f"_g_{g}" for g in groups])


def correlations(df: DataFrame, features, target: str, groups=(), min_n=2) -> DataFrame:
    """(groups..., feature, r, n) for every feature against the target."""
    tall = melt(df, [*groups, target], features)
    x, y = F.col("value"), F.col(target)
    out = tall.groupBy(*groups, "feature").agg(pearson(x, y).alias("r"), pairs_n(x, y).alias("n"))
    return out.where(F.col("n") >= min_n)


def correlation_tests(df: DataFrame, features, target: str, groups=(), alpha=0.05) -> DataFrame:
    """`correlations` with p, corrected p and significance, largest absolute r first."""
    out = correlations(df, features, target, groups).withColumn("p", t_pvalue(X.r_to_t(F.col("r"), F.col("n")), F.col("n") - 2.0))
    out = adjust(out, "p", groups).withColumn("abs_r", F.abs("r"))
    return out.withColumns({"sig_bonferroni": F.col("p_bonferroni") <= alpha, "sig_fdr": F.col("p_fdr") <= alpha}).orderBy(
        *groups, F.desc("abs_r"), "feature"
    )


def correlation_matrix(df: DataFrame, left, right, groups=()) -> DataFrame:
    """(groups..., a, b, r, n) for all left x right columns, each over the rows in which both are known."""
    return pair_tiles(df, left, right, CORRELATION, solve_correlations, "r double, n long", groups)


def pairwise_correlations(df: DataFrame, columns, groups=()) -> DataFrame:
    """Each unordered pair of columns once."""
    columns = sorted(columns)
    return pair_tiles(df, columns, columns, CORRELATION, solve_correlations, "r double, n long", groups, upper=True)


def contrast_group_correlations(df: DataFrame, columns, target: str, percentile=75) -> DataFrame:
    """Pairwise correlations in the high (>= P) and low (< 100-P) target groups with their Fisher z."""
    cuts = {r["prob"]: r["value"] for r in order_stats(df, target, [percentile / 100, 1 - percentile / 100]).collect()}
    high, low = cuts[percentile / 100], cuts[1 - percentile / 100]
    side = F.when(F.col(target) >= high, "high").when(F.col(target) < low, "low")
    grouped = df.withColumn("side", side).where(F.col("side").isNotNull())
    stats = pairwise_correlations(grouped, columns, ["side"])

    def of(s, c):
        return F.max(F.when(F.col("side") == s, F.col(c)))

    out = stats.groupBy("a", "b").agg(
        of("high", "r").alias("r_high"), of("low", "r").alias("r_low"), of("high", "n").alias("n_high"), of("low", "n").alias("n_low")
    )
    z = X.fisher_z(F.col("r_high"), F.col("n_high"), F.col("r_low"), F.col("n_low"), bound=None)
    return out.withColumn("z", z).withColumn("p", z_pvalue("z"))


def spearman(df: DataFrame, x: str, y: str, groups=(), weight: str | None = None) -> DataFrame:
    """(groups..., rho, n): rank correlation with average ranks over complete pairs.

    Equal pairs are collapsed first, so a value that fills the table is one row per partner value.
    """
    groups = list(groups)
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        *groups, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    ).agg(w.alias("_w"))
    pairs = stage(pairs)  # ranked twice, each time in several passes
    for side in ("_x", "_y"):
        ranks = average_ranks(pairs, side, groups, f"_r{side}", weight="_w")
        pairs = pairs.join(ranks, [*groups, side])
    mean = (F.sum("_w") + 1) / 2.0
    rx, ry, ww = F.col("_r_x"), F.col("_r_y"), F.col("_w")
    sums = pairs.groupBy(*groups).agg(
        F.sum(ww).alias("n"), F.sum(ww * rx * ry).alias("xy"), F.sum(ww * rx * rx).alias("xx"), F.sum(ww * ry * ry).alias("yy"),
        mean.alias("m"),
    )
    n, m = F.col("n"), F.col("m")
    rho = F.try_divide(F.col("xy") - n * m * m, F.sqrt((F.col("xx") - n * m * m) * (F.col("yy") - n * m * m)))
    return sums.select(*groups, rho.alias("rho"), "n")


def two_groups(df: DataFrame, features, first: Column, second: Column, groups=()) -> DataFrame:
    """Per feature: n, mean and sample variance of two row sets, from one conditional aggregate."""
    tall = melt(df.withColumns({"_a": F.coalesce(first, F.lit(False)), "_b": F.coalesce(second, F.lit(False))}), [*groups, "_a", "_b"], features)
    aggs = []
    for i, flag in ((1, "_a"), (2, "_b")):
        v = F.when(F.col(flag), F.col("value"))
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.var_samp(v).alias(f"var{i}")]
    return tall.groupBy(*groups, "feature").agg(*aggs)


def _six():
    return [F.col(c) for c in ("n1", "mean1", "var1", "n2", "mean2", "var2")]


def t_tests(df: DataFrame, features, first: Column, second: Column, groups=(), welch=False, min_n=2) -> DataFrame:
    """Two-sample t (pooled or Welch), Cohen's d, p and FDR per feature."""
    m = two_groups(df, features, first, second, groups).where((F.col("n1") >= min_n) & (F.col("n2") >= min_n))
    n1, m1, v1, n2, m2, v2 = _six()
    t = X.welch_t(n1, m1, v1, n2, m2, v2) if welch else X.pooled_t(n1, m1, v1, n2, m2, v2)
    dof = X.welch_df(n1, v1, n2, v2) if welch else (n1 + n2 - 2).cast("double")
    out = m.withColumns({"t": t, "df": dof, "cohens_d": X.cohens_d(n1, m1, v1, n2, m2, v2)}).withColumn("p", t_pvalue("t", "df"))
    return adjust(out, "p", groups)


def paired_t(df: DataFrame, id_col, timepoint, first, second, features) -> DataFrame:
    """Change from the first to the second visit of the same subject: n, mean, t, d and p per feature."""
    both = paired(df, id_col, timepoint, first, second, features)
    tall = melt(both.select(*[(F.col(f"{f}_2") - F.col(f"{f}_1")).alias(f) for f in features]), [], features)
    m = tall.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean_change"), F.stddev_samp("value").alias("sd"))
    t = F.try_divide(F.col("mean_change") * F.sqrt("n"), F.col("sd"))
    out = m.withColumns({"t": t, "cohens_d": F.try_divide(F.col("mean_change"), F.col("sd"))})
    return adjust(out.withColumn("p", t_pvalue("t", F.col("n") - 1.0)), "p")


def chi2_2x2(df: DataFrame, row: Column, column: Column) -> DataFrame:
    """Chi-square with continuity correction of two boolean columns; one aggregate."""
    out = df.agg(
        F.count_if(row & column).alias("a"), F.count_if(row & ~column).alias("b"),
        F.count_if(~row & column).alias("c"), F.count_if(~row & ~column).alias("d"),
    )
    out = out.withColumn("chi2", X.yates_chi2(*[F.col(c).cast("double") for c in "abcd"]))
    return out.withColumn("p", chi2_pvalue("chi2", F.lit(1.0)))


def asymmetry_versus_total(df: DataFrame, pairs, target: str) -> DataFrame:
    """Per structure: r of asymmetry and of total with the target, and the dependent-correlation z."""
    items = [
        F.struct(F.lit(n).alias("structure"), asymmetry(F.col(l), F.col(r)).alias("ai"), (F.col(l) + F.col(r)).cast("double").alias("total"))
        for n, l, r in pairs
    ]
    tall = df.select(F.col(target).cast("double").alias("_y"), F.explode(F.array(*items)).alias("_p"))
    tall = tall.select("_y", "_p.structure", "_p.ai", "_p.total").dropna("any", subset=["_y", "ai", "total"])
    ai, tot, y = F.col("ai"), F.col("total"), F.col("_y")
    m = tall.groupBy("structure").agg(
        pearson(ai, y).alias("r_ai"), pearson(tot, y).alias("r_total"), pearson(ai, tot).alias("r_ai_total"), F.count(F.lit(1)).alias("n")
    )
    df_ = F.col("n") - 2.0
    out = m.withColumns(
        {
            "z": X.dependent_z(F.col("r_ai"), F.col("r_total"), F.col("r_ai_total"), F.col("n")),
            "p_ai": t_pvalue(X.r_to_t(F.col("r_ai"), F.col("n")), df_),
            "p_total": t_pvalue(X.r_to_t(F.col("r_total"), F.col("n")), df_),
        }
    ).withColumn("p", z_pvalue("z"))
    return adjust(out, "p")


def sex_interaction(df: DataFrame, features, target: str, female: Column) -> DataFrame:
    """Per feature: interaction term of y ~ x + female + x*female, and r within each sex."""
    tall = melt(df.withColumn("_f", female.cast("double")), [target, "_f"], features)
    fit = ols(tall.withColumn("_xf", F.col("value") * F.col("_f")), target, ["value", "_f", "_xf"], ["feature"])
    slope = fit.where(F.col("term") == "_xf").select("feature", F.col("beta").alias("beta_interaction"), F.col("p").alias("p_interaction"))
    x, y = F.col("value"), F.col(target)
    by_sex = tall.groupBy("feature").agg(
        pearson(F.when(F.col("_f") == 0, x), y).alias("r_male"), pearson(F.when(F.col("_f") == 1, x), y).alias("r_female")
    )
    return adjust(slope.join(by_sex, "feature"), "p_interaction")


def pair_interactions(df: DataFrame, features, target: str) -> DataFrame:
    """y ~ a + b + a*b for every pair of features: coefficient, t, p and r2 of the full model, with corrected p."""
    features = sorted(features)
    fit = pair_tiles(df, features, features, INTERACTION, solve_interactions, "beta_interaction double, t double, r2 double, n long", target=target, upper=True)
    fit = stage(fit.withColumnsRenamed({"a": "feature_a", "b": "feature_b"}).withColumn("p_interaction", t_pvalue(F.col("t"), F.col("n") - 4.0)))
    return adjust_many(fit, "p_interaction")


def history_effects(df: DataFrame, features, target: str, history: str, ddof=1) -> tuple[DataFrame, DataFrame]:
    """Interaction of family history with z-scored features, and history-positive versus -negative t-tests."""
    yes, no = F.col(history) == 1, F.col(history) == 0
    tall = melt(df.where(yes | no), [target, history], features)
    stats = tall.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = F.try_divide(F.col("value") - F.col("_m"), F.col("_s"))
    scored = tall.join(stats, "feature").withColumn("x", z).withColumn("h", F.col(history).cast("double")).withColumn("xh", F.col("x") * F.col("h"))
    model = ols(scored, target, ["x", "h", "xh"], ["feature"])
    return model, t_tests(df, features, yes, no)


def three_way(df: DataFrame, left: str, right: str, target: str, sex: str, timepoint: str, baseline, follow_up, male="male", female="female") -> tuple[DataFrame, DataFrame]:
    """r of each hemisphere per (sex, visit), four Fisher z on the left side and the approximate 3-way z."""
    l, r, y = F.col(left), F.col(right), F.col(target)
    cells = df.where(F.col(timepoint).isin(baseline, follow_up) & F.col(sex).isin(male, female)).groupBy(sex, timepoint).agg(
        pearson(l, y).alias("r_left"), pairs_n(l, y).alias("n_left"), pearson(r, y).alias("r_right"), pairs_n(r, y).alias("n_right")
    )

    def pick(s, t, c):
        return F.max(F.when((F.col(sex) == s) & (F.col(timepoint) == t), F.col(c)))

    spots = {"mb": (male, baseline), "fb": (female, baseline), "my": (male, follow_up), "fy": (female, follow_up)}
    one = cells.agg(*[pick(*v, c).alias(f"{k}_{c[0]}") for k, v in spots.items() for c in ("r_left", "n_left")])

    def z(a, b):
        return X.fisher_z(F.col(f"{a}_r"), F.col(f"{a}_n"), F.col(f"{b}_r"), F.col(f"{b}_n"))

    gap = {t: F.atanh(clip(F.col(f"m{t}_r") - F.col(f"f{t}_r"), -0.9999, 0.9999)) for t in "by"}
    se = F.sqrt(sum((F.try_divide(F.lit(1.0), F.col(f"{k}_n") - 3) for k in spots), F.lit(0.0)))
    names = {
        "sex_baseline": z("mb", "fb"), "sex_follow_up": z("my", "fy"), "male_change": z("mb", "my"),
        "female_change": z("fb", "fy"), "three_way": (gap["b"] - gap["y"]) / se,
    }
    tests = one.select(*[c.alias(n) for n, c in names.items()]).unpivot([], list(names), "comparison", "z")
    return cells, tests.withColumn("p", z_pvalue("z"))


def demographic_effects(df: DataFrame, targets, age: str, sex: str, male="male", female="female", min_n=10) -> DataFrame:
    """Per target: r with age, sex means and pooled t; cells with too few rows are null."""
    tall = melt(df, [age, sex], targets, "target", "value").where(F.col("value").isNotNull())
    y, a = F.col("value"), F.col(age)
    aggs = [pearson(a, y).alias("r_"), pairs_n(a, y).alias("n_age")]
    for i, s in ((1, male), (2, female)):
        v = F.when(F.col(sex) == s, y)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.var_samp(v).alias(f"var{i}")]
    m = tall.groupBy("target").agg(*aggs)
    n1, m1, v1, n2, m2, v2 = _six()
    enough = (n1 > min_n) & (n2 > min_n)
    out = m.select(
        "target", F.when(F.col("n_age") > min_n, F.col("r_")).alias("age_r"), "n_age",
        F.when(enough, m1).alias("male_mean"), F.when(enough, m2).alias("female_mean"),
        F.when(enough, X.pooled_t(n1, m1, v1, n2, m2, v2)).alias("sex_t"), (n1 + n2 - 2.0).alias("_df"),
    )
    return out.withColumns(
        {"age_p": t_pvalue(X.r_to_t(F.col("age_r"), F.col("n_age")), F.col("n_age") - 2.0), "sex_p": t_pvalue("sex_t", "_df")}
    ).drop("_df", "n_age")


def sex_hemisphere(df: DataFrame, pair, target: str, sex: str, male="male", female="female") -> tuple[DataFrame, DataFrame]:
    """r of asymmetry, left and right by sex with FDR over the six, and male-versus-female Fisher z."""
    name, left, right = pair
    cols = df.where(F.col(sex).isin(male, female)).select(
        sex, target, asymmetry(F.col(left), F.col(right)).alias(f"{name}_AI"), F.col(left).cast("double").alias(left), F.col(right).cast("double").alias(right)
    )
    stats = correlations(cols, [f"{name}_AI", left, right], target, [sex])
    stats = adjust(stats.withColumn("p", t_pvalue(X.r_to_t(F.col("r"), F.col("n")), F.col("n") - 2.0)), "p")

    def of(s, c):
        return F.max(F.when(F.col(sex) == s, F.col(c)))

    both = stats.groupBy("feature").agg(of(male, "r").alias("r1"), of(male, "n").alias("n1"), of(female, "r").alias("r2"), of(female, "n").alias("n2"))
    z = both.select("feature", X.fisher_z(F.col("r1"), F.col("n1"), F.col("r2"), F.col("n2")).alias("z"))
    return stats, z.withColumn("p", z_pvalue("z"))


def lines(df: DataFrame, x: str, y: str, groups) -> DataFrame:
    """Simple regression line per group."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*groups).agg(
        F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), pearson(a, b).alias("r"), pairs_n(a, b).alias("n")
    )
