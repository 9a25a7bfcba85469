"""Classification and regression metrics over prediction tables (any grouping: fold, model, bootstrap)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from varve.operators.association import spearman
from varve.operators.bootstrap import draw_auc, draw_sums
from varve.operators.ordering import order_stats, running_sums
from varve.operators.resample import poisson_weights
from varve.operators.shape import edge_bin
from varve.session import stage


def ratio(a, b, empty=0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(empty))


def rates(tp="tp", fp="fp", fn="fn", tn="tn", beta=0.5) -> dict[str, Column]:
    """Every metric of a confusion table; an undefined ratio is 0, an absent class leaves balanced accuracy to the other."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in (tp, fp, fn, tn))
    pos, neg, called, passed = tp + fn, fp + tn, tp + fp, fn + tn
    n = pos + neg
    recall, spec, ppv = ratio(tp, pos), ratio(tn, neg), ratio(tp, called)
    classes = (pos > 0).cast("double") + (neg > 0).cast("double")
    base = ratio(pos, n)
    b2 = beta * beta
    return {
        "accuracy": ratio(tp + tn, n),
        "balanced_accuracy": ratio(recall + spec, classes),
        "precision_pos": ppv,
        "recall_pos": recall,
        "f1_pos": ratio(2 * tp, 2 * tp + fp + fn),
        "fbeta": ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp),
        "f2": ratio(5 * tp, 5 * tp + 4 * fn + fp),
        "specificity": spec,
        "npv": ratio(tn, passed),
        "fpr": ratio(fp, neg),
        "fnr": ratio(fn, pos),
        "fdr": ratio(fp, called),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt(called) * F.sqrt(pos) * F.sqrt(neg) * F.sqrt(passed)),
        "base_rate": base,
        "lift": ratio(ppv, base),
        "nns": F.try_divide(F.lit(1.0), ppv),
        "flagged": called,
    }


def confusion(df: DataFrame, y: str, pred: str, groups=(), weight: Column | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    yes, called = F.col(y) == 1, F.col(pred) == 1

    def cell(cond):
        return F.coalesce(F.sum(F.when(cond, w)), F.lit(0))

    return df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(*groups).agg(
        cell(yes & called).alias("tp"), cell(~yes & called).alias("fp"), cell(yes & ~called).alias("fn"), cell(~yes & ~called).alias("tn")
    )


def tall_metrics(df: DataFrame, groups, exprs: dict[str, Column]) -> DataFrame:
    """(groups..., metric, value)."""
    return df.select(*groups, *[e.cast("double").alias(n) for n, e in exprs.items()]).unpivot(list(groups), list(exprs), "metric", "value")


# The metrics reported for a classifier.
REPORTED = ["accuracy", "balanced_accuracy", "precision_pos", "recall_pos", "f1_pos"]


def classification_metrics(df: DataFrame, y: str, pred: str, score: str | None = None, groups=(), weight: str | None = None) -> DataFrame:
    table = confusion(df, y, pred, groups, None if weight is None else F.col(weight))
    exprs = rates()
    out = tall_metrics(table, groups, {m: exprs[m] for m in REPORTED})
    if score is None:
        return out
    auc = roc_auc(df, y, score, groups, weight).select(*groups, F.lit("roc_auc").alias("metric"), F.col("auc").alias("value"))
    return out.unionByName(auc)


def confusion_report(df: DataFrame, y: str, pred: str, groups=()) -> DataFrame:
    """The full list of rates beside the four counts."""
    return tall_metrics(confusion(df, y, pred, groups), groups, {c: F.col(c) for c in ("tp", "fp", "fn", "tn")} | rates())


def score_counts(df: DataFrame, y: str, score: str, groups=(), weight: str | None = None) -> DataFrame:
    """Positives and negatives at each distinct score: equal scores become one row before anything is ordered."""
    w = F.lit(1) if weight is None else F.col(weight)
    yes = F.col(y) == 1
    return df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*groups, F.col(score).cast("double").alias("score")).agg(
        F.coalesce(F.sum(F.when(yes, w)), F.lit(0)).alias("pos"), F.coalesce(F.sum(F.when(~yes, w)), F.lit(0)).alias("neg")
    )


def _curve(df, y, score, groups, weight=None):
    return running_sums(score_counts(df, y, score, groups, weight), "score", ["pos", "neg"], groups, descending=True)


def roc_auc(df: DataFrame, y: str, score: str, groups=(), weight: str | None = None) -> DataFrame:
    """Exact area with ties (Mann-Whitney); null where only one class is present."""
    below = F.col("tot_neg") - F.col("cum_neg") + F.col("neg") / 2
    area = F.sum(F.col("pos") * below)
    return _curve(df, y, score, groups, weight).groupBy(*groups).agg(
        F.try_divide(area, (F.max("tot_pos") * F.max("tot_neg")).cast("double")).alias("auc")
    )


def roc_points(df: DataFrame, y: str, score: str, groups=()) -> DataFrame:
    """One point per distinct score: threshold, false and true positive rates, cumulative counts."""
    return _curve(df, y, score, groups).select(
        *groups, F.col("score").alias("threshold"), ratio(F.col("cum_neg"), F.col("tot_neg")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("tot_pos")).alias("tpr"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
    )


def pr_points(df: DataFrame, y: str, score: str, groups=()) -> DataFrame:
    return _curve(df, y, score, groups).select(
        *groups, F.col("score").alias("threshold"), (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        ratio(F.col("cum_pos"), F.col("tot_pos")).alias("recall"),
    )


def average_precision(df: DataFrame, y: str, score: str, groups=()) -> DataFrame:
    step = F.col("pos") / F.greatest(F.col("tot_pos"), F.lit(1)) * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return _curve(df, y, score, groups).groupBy(*groups).agg(F.sum(step).alias("ap"))


def threshold_table(df: DataFrame, y: str, score: str, thresholds, groups=(), beta=0.5) -> DataFrame:
    """Confusion counts and rates at every threshold (score >= threshold), one row per threshold.

    Rows are counted once by how many thresholds they pass; the cumulation runs on that tiny table.
    """
    grid = sorted(set(float(t) for t in thresholds))
    passed = F.lit(0)
    for t in grid:
        passed = passed + (F.col(score) >= t).cast("int")
    yes = (F.col(y) == 1).cast("long")
    cells = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*groups, passed.alias("_i")).agg(
        F.sum(yes).alias("p"), F.sum(1 - yes).alias("q")
    )
    points = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(t).alias("threshold")) for j, t in enumerate(grid)])
    tall = cells.withColumn("_t", F.explode(points))
    hit = F.col("_i") > F.col("_t.j")

    def total(cond, c):
        return F.sum(F.when(cond, F.col(c)).otherwise(0))

    table = tall.groupBy(*groups, F.col("_t.threshold").alias("threshold")).agg(
        total(hit, "p").alias("tp"), total(hit, "q").alias("fp"), total(~hit, "p").alias("fn"), total(~hit, "q").alias("tn")
    )
    return table.select("*", *[e.alias(n) for n, e in rates(beta=beta).items()])


def threshold_sweep(df: DataFrame, y: str, score: str, points=100, low=0.0, high=1.0, groups=()) -> DataFrame:
    return threshold_table(df, y, score, [low + (high - low) * i / (points - 1) for i in range(points)], groups)


def best_threshold(df: DataFrame, y: str, score: str, thresholds, metric="balanced_accuracy", default=0.5, groups=(), beta=0.5) -> DataFrame:
    """(groups..., threshold, value): the first threshold with the highest metric."""
    grid = list(thresholds) or [default]
    name = {"precision": "precision_pos"}.get(metric, metric)
    table = threshold_table(df, y, score, grid, groups, beta)
    order = F.struct(-F.round(F.col(name), 12), F.col("threshold"))
    return table.groupBy(*groups).agg(F.min_by("threshold", order).alias("threshold"), F.max(name).alias("value"))


def precision_at_k(df: DataFrame, y: str, score: str, tie: str, step=10, below=500) -> DataFrame:
    """Precision among the k highest scores, k = step, 2*step, ... < below; only the top rows are ever ordered."""
    top = df.orderBy(F.desc(score), tie).limit(below - 1).select(score, tie, y)
    order = W.partitionBy(F.lit(0)).orderBy(F.desc(score), F.col(tie))
    ranked = top.withColumns(
        {"k": F.row_number().over(order), "hits": F.sum(y).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))}
    )
    return ranked.where(F.col("k") % step == 0).select("k", (F.col("hits") / F.col("k")).alias("precision"))


def calibration(df: DataFrame, y: str, score: str, bins=10) -> DataFrame:
    """Mean score and observed rate in equal-frequency score bins."""
    rows = order_stats(df, score, [i / bins for i in range(bins + 1)]).collect()
    edges = sorted({r["value"] for r in rows})
    return df.withColumn("bin", edge_bin(F.col(score), edges)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("observed")
    )


def confidence_bins(df: DataFrame, y: str, score: str, edges, threshold=0.5) -> DataFrame:
    """Half-open score bins: rows, actual positives and precision of the rows called positive."""
    index = F.when((F.col(score) >= edges[0]) & (F.col(score) < edges[-1]), F.lit(0))
    for e in edges[1:-1]:
        index = index + (F.col(score) >= e).cast("int")
    called = F.col(score) >= threshold
    return df.withColumn("bin", index).where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"), F.avg(F.when(called, F.col(y))).alias("ppv")
    )


def quadrant(y: str, pred: str) -> Column:
    yes, called = F.col(y) == 1, F.col(pred) == 1
    return F.when(yes & called, "TP").when(~yes & called, "FP").when(yes, "FN").otherwise("TN")


def error_summary(df: DataFrame, y: str, pred: str, score: str) -> DataFrame:
    return df.groupBy(quadrant(y, pred).alias("quadrant")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), F.min(score).alias("min"), F.max(score).alias("max")
    )


def error_examples(df: DataFrame, y: str, pred: str, score: str, id_col: str, k=10, threshold=0.5) -> DataFrame:
    """Most confident false positives, false negatives nearest the threshold and most confident true positives."""
    tagged = df.select(id_col, score, quadrant(y, pred).alias("quadrant"), (F.lit(threshold) - F.col(score)).alias("gap"))

    def take(q, *order):
        return tagged.where(F.col("quadrant") == q).orderBy(*order, id_col).limit(k)

    return take("FP", F.desc(score)).unionByName(take("FN", "gap")).unionByName(take("TP", F.desc(score)))


def pooled_classification(df: DataFrame, y: str, pred: str, fold: str, score: str | None = None) -> DataFrame:
    """(scope, metric, value): pooled metrics, and mean and population SD of the fold metrics."""
    overall = classification_metrics(df, y, pred, score).select(F.lit("overall").alias("scope"), "metric", "value")
    return overall.unionByName(_across(classification_metrics(df, y, pred, score, [fold]), ("mean", "std")))


def _across(metrics: DataFrame, stats) -> DataFrame:
    fns = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    wide = metrics.groupBy("metric").agg(*[fns[s]("value").alias(s) for s in stats])
    return wide.unpivot(["metric"], list(stats), "scope", "value").select("scope", "metric", "value")


def regression_sums(df: DataFrame, y: str, pred: str, groups=(), weight: str | None = None) -> DataFrame:
    """The sums every regression metric needs, in one aggregate; values are shifted by a constant near the mean."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    a, b = F.col(y).cast("double"), F.col(pred).cast("double")
    err = a - b
    named = {
        "n": w, "sa": w * a, "sb": w * b, "saa": w * a * a, "sbb": w * b * b, "sab": w * a * b,
        "sae": w * F.abs(err), "sse": w * err * err,
    }
    return df.where(a.isNotNull() & b.isNotNull()).groupBy(*groups).agg(
        *[F.sum(e).alias(n) for n, e in named.items()], F.min(a).alias("amin"), F.max(a).alias("amax"), F.min(b).alias("bmin"), F.max(b).alias("bmax")
    )


def regression_exprs() -> dict[str, Column]:
    c = F.col
    va, vb = c("saa") - c("sa") * c("sa") / c("n"), c("sbb") - c("sb") * c("sb") / c("n")
    cov = c("sab") - c("sa") * c("sb") / c("n")
    flat = (c("n") <= 1) | (c("amax") - c("amin") < 1e-10) | (c("bmax") - c("bmin") < 1e-10)
    mse = c("sse") / c("n")
    return {
        "r2": F.when(va > 0, 1 - c("sse") / va).otherwise(F.lit(0.0)),
        "mae": c("sae") / c("n"), "mse": mse, "rmse": F.sqrt(mse),
        "pearson_r": F.when(flat | (va <= 0) | (vb <= 0), F.lit(0.0)).otherwise(cov / F.sqrt(va * vb)),
    }


def regression_metrics(df: DataFrame, y: str, pred: str, groups=(), ranks=True) -> DataFrame:
    """r2, mae, mse, rmse, Pearson and Spearman; 0 where a side is constant or a single row is left.

    Values are first shifted by the overall mean of y, which changes no metric and keeps the sums small.
    """
    groups = list(groups)
    mean = df.agg(F.avg(F.col(y).cast("double"))).first()[0] or 0.0
    moved = df.withColumns({"_a": F.col(y).cast("double") - mean, "_b": F.col(pred).cast("double") - mean})
    out = tall_metrics(regression_sums(moved, "_a", "_b", groups), groups, regression_exprs())
    if not ranks:
        return out
    rho = spearman(moved, "_a", "_b", groups).select(*groups, F.lit("spearman_r").alias("metric"), F.coalesce("rho", F.lit(0.0)).alias("value"))
    return out.unionByName(rho)


def pooled_regression(df: DataFrame, y: str, pred: str, fold: str, ranks=True) -> DataFrame:
    """(scope, metric, value): pooled metrics and mean, SD, min, max over folds. The predictions are read some ten times, so they are written once."""
    df = stage(df.select(F.col(fold), F.col(y).cast("double").alias(y), F.col(pred).cast("double").alias(pred)))
    overall = regression_metrics(df, y, pred, (), ranks).select(F.lit("overall").alias("scope"), "metric", "value")
    return overall.unionByName(_across(regression_metrics(df, y, pred, [fold], ranks), ("mean", "std", "min", "max")))


def intervals(draws: DataFrame, groups, level=0.95) -> DataFrame:
    """Mean and percentile interval per metric over bootstrap draws (a table of draws x metrics rows)."""
    a = (1 - level) / 2
    return draws.groupBy(*groups, "metric").agg(
        F.avg("value").alias("mean"), F.percentile("value", F.lit(a)).alias("lower"), F.percentile("value", F.lit(1 - a)).alias("upper")
    )


def bootstrap_classification(df: DataFrame, ids, y: str, pred: str, score: str | None, draws: int, seed=42, level=0.95) -> DataFrame:
    """(metric, mean, lower, upper) of the reported metrics and, with `score`, of the area under the ROC curve."""
    yes, called = F.col(y) == 1, F.col(pred) == 1
    cells = {"tp": yes & called, "fp": ~yes & called, "fn": yes & ~called, "tn": ~yes & ~called}
    known = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    exprs = rates()
    out = tall_metrics(draw_sums(known, ids, cells, draws, seed), ["b"], {m: exprs[m] for m in REPORTED})
    if score:
        out = out.unionByName(draw_auc(df, ids, y, score, draws, seed).select("b", F.lit("roc_auc").alias("metric"), F.col("auc").alias("value")))
    return intervals(out, [], level)


def _draw_exprs(prefix="") -> dict[str, Column]:
    """Metrics of one draw from its sums. A side counts as constant when its spread is lost beside its distance from the overall mean."""
    c = lambda n: F.col(prefix + n)
    va, vb = c("saa") - c("sa") * c("sa") / c("n"), c("sbb") - c("sb") * c("sb") / c("n")
    cov = c("sab") - c("sa") * c("sb") / c("n")
    flat = (c("n") <= 1) | (va <= 1e-12 * c("saa")) | (vb <= 1e-12 * c("sbb"))
    out = {"pearson_r": F.when(flat, F.lit(0.0)).otherwise(cov / F.sqrt(va * vb))}
    if not prefix:
        mse = c("sse") / c("n")
        out |= {"r2": F.when(va > 1e-12 * c("saa"), 1 - c("sse") / va).otherwise(F.lit(0.0)), "mae": c("sae") / c("n"), "mse": mse, "rmse": F.sqrt(mse)}
    return out


def bootstrap_regression(df: DataFrame, ids, y: str, pred: str, draws: int, seed=42, level=0.95, ranks=False) -> DataFrame:
    """Intervals of the regression metrics; `ranks` adds Spearman, which needs one ordering, and a row, per draw."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    mean = df.agg(F.avg(F.col(y).cast("double")).alias("mean")).first()["mean"] or 0.0
    moved = df.select(*ids, (F.col(y).cast("double") - mean).alias("_a"), (F.col(pred).cast("double") - mean).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    stats = {"n": F.lit(1.0), "sa": a, "sb": b, "saa": a * a, "sbb": b * b, "sab": a * b, "sae": F.abs(a - b), "sse": (a - b) * (a - b)}
    out = tall_metrics(draw_sums(moved.where(a.isNotNull() & b.isNotNull()), ids, stats, draws, seed), ["b"], _draw_exprs())
    if ranks:
        weighted = poisson_weights(moved, ids, draws, seed)
        rho = spearman(weighted, "_a", "_b", ["b"], "w").select("b", F.lit("spearman_r").alias("metric"), F.coalesce("rho", F.lit(0.0)).alias("value"))
        out = out.unionByName(rho)
    return intervals(out, [], level)


def bootstrap_correlations(df: DataFrame, ids, features, target: str, draws: int, seed=42, level=0.95) -> DataFrame:
    """Per feature: observed r, interval and sign-based two-sided bootstrap p."""
    from varve.operators.association import correlations

    ids, features = [ids] if isinstance(ids, str) else list(ids), list(features)
    mean = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate([target, *features])]).first()
    centred = [F.col(c).cast("double") - F.lit(mean[f"m{i}"] or 0.0) for i, c in enumerate([target, *features])]
    stats = {}
    for i, b in enumerate(centred[1:]):
        a = F.when(b.isNotNull(), centred[0])
        b = F.when(a.isNotNull(), b)
        named = {"n": F.when(a.isNotNull(), F.lit(1.0)), "sa": a, "sb": b, "saa": a * a, "sbb": b * b, "sab": a * b}
        stats |= {f"f{i}_{n}": e for n, e in named.items()}
    sums = draw_sums(df, ids, stats, draws, seed)
    rs = sums.select("b", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"f{i}_n").alias("n"), _draw_exprs(f"f{i}_")["pearson_r"].alias("value")) for i, f in enumerate(features)
    ])).alias("_r")).select("b", "_r.*").where("n > 0")
    a = (1 - level) / 2
    out = rs.groupBy("feature").agg(
        F.percentile("value", F.lit(a)).alias("lower"), F.percentile("value", F.lit(1 - a)).alias("upper"),
        F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("value") <= 0).cast("int")), F.avg((F.col("value") >= 0).cast("int")))).alias("p_boot"),
    )
    return correlations(df, features, target).select("feature", "r").join(out, "feature")


def ensemble_average(df: DataFrame, keys, score="score", threshold=0.5) -> DataFrame:
    """Mean member score per row and its label."""
    return df.groupBy(*keys).agg(F.avg(score).alias(score)).withColumn("yhat", (F.col(score) >= threshold).cast("int"))


def coefficient_summary(coefficients: DataFrame, feature="feature", value="value") -> DataFrame:
    """Mean and SD over folds of the coefficients, with mean absolute importance, most important first."""
    return coefficients.groupBy(feature).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.avg(F.abs(F.col(value))).alias("importance")
    ).orderBy(F.desc("importance"), feature)


def residual_report(coefficients: DataFrame) -> DataFrame:
    """Per-fold residualization terms followed by their mean and SD rows: (fold, term, value) -> (row, term, value)."""
    folds = coefficients.select(F.col("fold").cast("string").alias("row"), "term", "value")
    agg = coefficients.groupBy("term").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return folds.unionByName(agg.unpivot(["term"], ["mean", "sd"], "row", "value").select("row", "term", "value"))


def rank_agreement(univariate: DataFrame, coefficients: DataFrame, r="r", value="value", feature="feature") -> DataFrame:
    """Spearman agreement of univariate correlations and model coefficients over shared features."""
    return spearman(univariate.join(coefficients, feature), r, value)
