"""Robustness studies: cutoffs, replication halves, leave-one-out, random networks, strata, one per family."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.functions import effects as X
from varve.functions.pvalues import t_pvalue
from varve.functions.scalars import asymmetry_columns
from varve.models import gram as G
from varve.models import regression as R
from varve.operators import association as A
from varve.operators.combat import harmonize_guarded
from varve.operators.row_sets import halves_of, members_of
from varve.operators.shape import best_signed, melt
from varve.operators.splits import random_draw, random_halves, random_member
from varve.session import stage, stage_small

# Severity cutoffs swept.
CUTOFFS = tuple(range(0, 65, 5))


def cutoff_sweep(df: DataFrame, features, target: str, cutoffs=CUTOFFS, min_n=50) -> DataFrame:
    """(cutoff, feature, r, n) among rows with target >= cutoff.

    Rows are summed once by the number of cutoffs they pass; every cutoff is a suffix of those few levels.
    """
    cutoffs = sorted(cutoffs)
    level = F.lit(0)
    for c in cutoffs:
        level = level + (F.col(target) >= c).cast("int")
    known = df.where(F.col(target).isNotNull())
    shift = known.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in [*features, target]]).first()
    moved = known.select(
        level.alias("_l"), (F.col(target).cast("double") - F.lit(shift[target] or 0.0)).alias("_y"),
        *[(F.col(f).cast("double") - F.lit(shift[f] or 0.0)).alias(f) for f in features],
    )
    tall = melt(moved, ["_l", "_y"], features).where(F.col("value").isNotNull())
    x, y = F.col("value"), F.col("_y")
    sums = tall.groupBy("_l", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")
    )
    points = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(c)).alias("cutoff")) for j, c in enumerate(cutoffs)])
    cum = sums.withColumn("_c", F.explode(points)).where(F.col("_l") > F.col("_c.j")).groupBy(F.col("_c.cutoff").alias("cutoff"), "feature").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    )
    c = F.col
    vx, vy = c("sxx") - c("sx") * c("sx") / c("n"), c("syy") - c("sy") * c("sy") / c("n")
    out = cum.where(c("n") >= min_n).select("cutoff", "feature", F.try_divide(c("sxy") - c("sx") * c("sy") / c("n"), F.sqrt(vx * vy)).alias("r"), "n")
    return out.withColumn("p", t_pvalue(X.r_to_t(c("r"), c("n")), c("n") - 2.0))


def split_halves(df: DataFrame, spec: R.Spec, iterations=10, model="ridge") -> tuple[DataFrame, DataFrame]:
    """(iteration, r_first_half, r_second_half) and the replication summary; siblings stay in one half.

    Every half is a set of rows of one aggregate by fold and site: iterations add columns to a matrix, neither rows nor passes. Where the
    scores do not follow from such sums, every half is a group of the same two aggregates, and iterations add rows.
    """
    prepared = R.prepare(df, spec)
    if model != "svr" and R.additive(spec):
        rows, deal, more = halves_of(prepared.rows, spec.family, iterations, spec.seed)
        scores = R.fold_scores(prepared, model, rows=rows, deal=deal, more=more).withColumns(
            {"iteration": F.col("member") % iterations, "half": F.when(F.col("member") < iterations, "a").otherwise("b")}
        )
    else:
        halves = random_halves(prepared.rows, spec.family, iterations, spec.seed)
        rows = prepared.rows.join(halves.hint("merge"), spec.family)
        groups = ["iteration", "half"]
        scores = R.pooled(prepared, prepared.frame(groups, rows=rows), model, groups)
    table = stage_small(scores.groupBy("iteration").agg(
        F.max(F.when(F.col("half") == "a", F.col("pearson_r"))).alias("r_first_half"), F.max(F.when(F.col("half") == "b", F.col("pearson_r"))).alias("r_second_half")
    ))
    a, b = F.col("r_first_half"), F.col("r_second_half")
    summary = table.agg(
        F.avg(((a > 0) & (b > 0)).cast("int")).alias("share_replicated"), F.median(a).alias("median_first"), F.median(b).alias("median_second"), F.count(F.lit(1)).alias("iterations")
    )
    return table, summary


def leave_one_out(df: DataFrame, spec: R.Spec, model="ridge") -> DataFrame:
    """(feature, r_without, delta_r): each feature's row and column leave the cross products; nothing is rescanned.

    For `svr` every feature left out is one more fit over the same rows, to which its column is zero.
    """
    prepared = R.prepare(df, spec)
    if model == "svr":
        scores = stage_small(R.svr_without_each(prepared, stage(prepared.frame())))
        base = scores.where("without = 0").select("pearson_r").scalar()
        feature = F.element_at(F.array(*[F.lit(c) for c in spec.inputs]), F.col("without"))
        return scores.where("without > 0").select(
            feature.alias("feature"), F.col("pearson_r").alias("r_without"), (base - F.col("pearson_r")).alias("delta_r")
        ).orderBy(F.desc("delta_r"), "feature")
    scores = stage_small(G.pooled_r(R.fits(prepared, prepared.frame(), [model], drop_each=True)))
    mark = f"{model}-without-"
    base = scores.where(F.col("model") == model).select("pearson_r").scalar()
    return scores.where(F.col("model").startswith(mark)).select(
        F.expr(f"substring(model, {len(mark) + 1})").alias("feature"), F.col("pearson_r").alias("r_without"), (base - F.col("pearson_r")).alias("delta_r")
    ).orderBy(F.desc("delta_r"), "feature")


def network_null(correlations: DataFrame, draws: int, m: int, seed=42) -> DataFrame:
    """(draw, feature, r): the strongest correlation among m random features per draw.

    `correlations` (feature, r) is computed once for the whole pool; a draw only picks rows of it.
    """
    small = stage_small(correlations.select("feature", "r"))
    picks = random_draw(small, "feature", draws, m, seed)
    return best_signed(picks.join(small, "feature"), ["draw"], "feature", "r")


def null_percentile(null: DataFrame, observed: float) -> DataFrame:
    """Share of draws below the observed strength, and the permutation p."""
    seen = F.abs(F.col("r"))
    return null.agg(
        (F.count_if(seen < abs(observed)) / F.count(F.lit(1)) * 100).alias("percentile"),
        ((1 + F.count_if(seen >= abs(observed))) / (1 + F.count(F.lit(1)))).alias("p"),
    )


def compare_networks(df: DataFrame, spec: R.Spec, networks: dict[str, tuple[str, ...]], model="ridge") -> DataFrame:
    """Pooled r of each named feature network over identical folds."""
    prepared = R.prepare(df, spec)
    out = None
    for name, features in networks.items():
        variant = replace(spec, features=tuple(features))
        part = R.pooled(prepared, prepared.frame(spec=variant), model, spec=variant).withColumn("network", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("network", "pearson_r", "n")


def stratified_correlations(df: DataFrame, by: str, pairs, target: str, min_n: int, site=None, covariates=()) -> DataFrame:
    """Asymmetry-score correlations per stratum; with a site, harmonized on the full sample first."""
    rows = df
    if site:
        rows = harmonize_guarded(df.where(F.col(target).isNotNull()), list(dict.fromkeys(c for _, l, r in pairs for c in (l, r))), site, covariates)
    ai = rows.select(by, target, *asymmetry_columns(pairs, total=False))
    out = A.correlations(ai, [f"{n}_AI" for n, _, _ in pairs], target, [by], min_n)
    return out.withColumn("p", t_pvalue(X.r_to_t(F.col("r"), F.col("n")), F.col("n") - 2.0))


def one_per_family(df: DataFrame, spec: R.Spec, iterations=10, model="ridge", level=0.95) -> tuple[DataFrame, DataFrame]:
    """Pooled r with one random member per family, per iteration; and median, interval and empirical p."""
    prepared = R.prepare(df, spec)
    if model != "svr" and R.additive(spec):
        rows, deal, more = members_of(prepared.rows, spec.family, spec.id, iterations, spec.seed)
        scores = R.fold_scores(prepared, model, rows=rows, deal=deal, more=more).withColumnRenamed("member", "iteration")
    else:
        tall = prepared.rows.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
        chosen = random_member(tall, spec.family, spec.id, F.col("it"), spec.seed)
        rows = stage(chosen.drop(spec.family).hint("merge").join(prepared.rows, spec.id))
        scores = R.pooled(prepared, prepared.frame(["iteration"], rows=rows), model, ["iteration"])
    table = stage_small(scores.select("iteration", "pearson_r"))
    a = (1 - level) / 2
    summary = table.agg(
        F.median("pearson_r").alias("median"), F.percentile("pearson_r", F.lit(a)).alias("lower"), F.percentile("pearson_r", F.lit(1 - a)).alias("upper"),
        ((1 + F.count_if(F.col("pearson_r") <= 0)) / (1 + F.count("pearson_r"))).alias("p_emp"),
    )
    return table, summary


def by_group_cv(df: DataFrame, spec: R.Spec, group: str, model="ridge") -> DataFrame:
    """Independent nested CV per group value (sex); the group leaves the covariates because it is constant there."""
    less = replace(spec, covariates=tuple(c for c in spec.covariates if c != group), residualize=tuple(c for c in spec.residualize if c != group))
    prepared = R.prepare(df, less, keep=[group])
    return R.pooled(prepared, prepared.frame([group]), model, [group])


def alternative_targets(df: DataFrame, spec: R.Spec, targets, model="ridge") -> DataFrame:
    """The same study on other outcomes, or without its score range; the input's own joins run once for all."""
    columns = [spec.id, spec.site, *spec.features, *spec.covariates, *spec.residualize, *spec.covariate_features, *([spec.family] if spec.family else [])]
    df = stage(df.select(*dict.fromkeys([*columns, *[target for target, _ in targets.values()]])))
    out = None
    for name, (target, score_range) in targets.items():
        variant = replace(spec, target=target, score_range=score_range)
        prepared = R.prepare(df, variant)
        scores = R.fold_scores(prepared, model) if model != "svr" and R.additive(variant) else R.pooled(prepared, prepared.frame(), model)
        part = scores.withColumn("study", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("study", "pearson_r", "r2", "n")
