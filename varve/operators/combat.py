"""Site harmonization: one moment aggregate to fit (all folds at once), one small join to apply."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.site_effects import fit_sites
from varve.operators.joins import paired
from varve.operators.missing import any_null
from varve.operators.prep import complete, covariate_frame, drop_small_groups, range_filter, target_filter
from varve.operators.shape import melt
from varve.operators.weighting import apply_residualizer, fit_residualizer
from varve.session import stage

MIN_ROWS = 30


def site_moments(df: DataFrame, features, site: str, covariates, groups, shift: dict) -> DataFrame:
    """(groups..., site, feature, n, sx, sxx, sc*, scc*, scx*): additive sums of the shifted values.

    The table has groups x sites x features rows, whatever the size of the data.
    """
    shifted = df.select(
        *groups, F.col(site).cast("string").alias("site_"),
        *[(F.col(c).cast("double") - F.lit(shift[c])).alias(f"c{i}_") for i, c in enumerate(covariates)],
        *[(F.col(f).cast("double") - F.lit(shift[f])).alias(f) for f in features],
    )
    cov = [f"c{i}_" for i in range(len(covariates))]
    tall = melt(shifted, [*groups, "site_", *cov], features)
    x = F.col("value")
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx")]
    for i, c in enumerate(cov):
        aggs += [F.sum(c).alias(f"sc{i}"), F.sum(F.col(c) * x).alias(f"scx{i}")]
        aggs += [F.sum(F.col(c) * F.col(e)).alias(f"scc{i}_{j}") for j, e in enumerate(cov) if j >= i]
    return tall.groupBy(*groups, "site_", "feature").agg(*aggs)


@dataclass
class SiteModel:
    """Fitted affine maps: `table` has one row per (groups..., site) with arrays over the features."""

    table: DataFrame
    features: list[str]
    covariates: list[str]
    site: str
    groups: list[str] = field(default_factory=list)
    scaled: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        """Harmonized (and scaled) features in place; a site never seen in training gives null."""
        renamed = self.table.withColumnRenamed("site_", "_site")
        joined = df.withColumn("_site", F.col(self.site).cast("string")).join(renamed, [*self.groups, "_site"], "left")
        q = len(self.covariates)
        out = {}
        for i, f in enumerate(self.features):
            value = F.get("_slope", F.lit(i)) * F.col(f) + F.get("_const", F.lit(i))
            for k, c in enumerate(self.covariates):
                value = value + F.get("_cov", F.lit(i * q + k)) * F.col(c)
            out[f] = F.when(F.isnan(value), F.lit(None)).otherwise(value)
        return joined.withColumns(out).drop("_site", "_slope", "_const", "_cov")

    def unseen(self, df: DataFrame) -> DataFrame:
        """Rows per site that the model does not know."""
        known = self.table.select(F.col("site_").alias("_site")).distinct()
        return df.withColumn("_site", F.col(self.site).cast("string")).join(known, "_site", "left_anti").groupBy(self.site).agg(F.count(F.lit(1)).alias("rows"))


def fit_site_model(
    df: DataFrame, features, site: str, covariates=(), fold: str | None = None, k: int | None = None, groups=(),
    eb=True, scale=False, harmonize=True, reference=None, min_variance=1e-10,
) -> SiteModel:
    """Learn site effects on complete rows.

    With `fold`, the moments are summed per fold once and every run r is fitted from the total without fold r, so
    k trainings cost one pass. `groups` fits independent models (halves, sexes, visits). `scale` folds the
    post-harmonization standardisation into the same map; features without variance become 0.
    """
    features, covariates, groups = list(features), list(covariates), list(groups)
    rows = df.where(complete([*features, *covariates, site]))
    means = rows.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in [*features, *covariates]]).first()
    shift = {c: means[c] or 0.0 for c in [*features, *covariates]}
    keys = groups + ([fold] if fold else [])
    moments = site_moments(rows, features, site, covariates, keys, shift)
    if fold:
        moments = moments.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("run") != F.col(fold))
        sums = [c for c in moments.columns if c not in {*groups, fold, "run", "site_", "feature"}]
        moments = moments.groupBy(*groups, "run", "site_", "feature").agg(*[F.sum(c).alias(c) for c in sums])
        groups = [*groups, "run"]
    kinds = dict(moments.dtypes)
    schema = ", ".join([f"`{g}` {kinds[g]}" for g in groups] + ["site_ string, _slope array<double>, _const array<double>, _cov array<double>"])
    mu_x, mu_c = np.array([shift[f] for f in features]), np.array([shift[c] for c in covariates])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return _maps(pdf, features, len(covariates), groups, mu_x, mu_c, eb, scale, harmonize, reference, min_variance)

    # One group is one model: sites x features rows of sums.
    grouped = moments.groupBy(*groups) if groups else moments.withColumn("_all", F.lit(0)).groupBy("_all")
    return SiteModel(stage(grouped.applyInPandas(fit, schema)), features, covariates, site, groups, scale)


def _maps(pdf, features, q, groups, mu_x, mu_c, eb, scale, harmonize, reference, min_variance):
    sites = sorted(pdf["site_"].unique())
    at = {s: i for i, s in enumerate(sites)}
    which = {f: i for i, f in enumerate(features)}
    si, fi = pdf["site_"].map(at).to_numpy(), pdf["feature"].map(which).to_numpy()

    def cube(name):
        out = np.zeros((len(sites), len(features)))
        out[si, fi] = pdf[name].to_numpy(dtype=float)
        return out

    n = cube("n").max(axis=1)
    sx, sxx = cube("sx"), cube("sxx")
    sc = np.stack([cube(f"sc{i}")[:, 0] for i in range(q)], axis=1) if q else np.zeros((len(sites), 0))
    scx = np.stack([cube(f"scx{i}") for i in range(q)], axis=1) if q else np.zeros((len(sites), 0, len(features)))
    scc = np.zeros((len(sites), q, q))
    for i in range(q):
        for j in range(i, q):
            scc[:, i, j] = scc[:, j, i] = cube(f"scc{i}_{j}")[:, 0]
    slope, const, cov = site_maps(n, sx, sxx, sc, scx, scc, mu_x, mu_c, eb, scale, harmonize, at.get(reference) if reference is not None else None, min_variance)
    out = pd.DataFrame(
        {
            "site_": sites, "_slope": [r.tolist() for r in slope], "_const": [r.tolist() for r in const],
            "_cov": [cov[i].T.reshape(-1).tolist() for i in range(len(sites))],
        }
    )
    for g in groups:
        out[g] = pdf[g].iloc[0]
    return out[[*groups, "site_", "_slope", "_const", "_cov"]]


def site_maps(n, sx, sxx, sc, scx, scc, mu_x, mu_c, eb=True, scale=False, harmonize=True, ref=None, min_variance=1e-10):
    """Slope and constant (sites x features) and covariate terms (sites x covariates x features) of raw values, from the moments of
    values shifted by `mu_x` and `mu_c`."""
    raw_var = sxx.sum(axis=0) / n.sum() - (sx.sum(axis=0) / n.sum()) ** 2
    if harmonize and len(n) > 1:
        slope, const, cov, mean, sd = fit_sites(n, sc, scc, sx, sxx, scx, eb, ref)
    else:
        slope, const, cov = np.ones_like(sx), np.zeros_like(sx), np.zeros_like(scx)
        mean, sd = sx.sum(axis=0) / n.sum(), np.sqrt(np.maximum(raw_var, 0))
    # From shifted to raw coordinates.
    const = const + mu_x - slope * mu_x - np.einsum("q,sqg->sg", mu_c, cov)
    if scale:
        div = np.where(sd > 0, sd, 1.0)
        slope, const, cov = slope / div, (const - mu_x - mean) / div, cov / div
        dead = ~(raw_var > min_variance)
        slope[:, dead], const[:, dead], cov[:, :, dead] = 0.0, 0.0, 0.0
    return slope, const, cov


def harmonize_guarded(df: DataFrame, features, site: str, covariates=(), min_site_n=5, eb=True) -> DataFrame:
    """Harmonize what can be: complete rows of sites large enough; under 30 rows the raw values stay.

    Adds `harmonized`. Covariates without any value, and constant ones, are left out.
    """
    rows = drop_small_groups(stage(df.where(complete([*features, site]))), site, min_site_n)
    known = rows.agg(*[F.count(c).alias(c) for c in covariates]).first() if covariates else {}
    usable = [c for c in covariates if known[c] > 0]
    rows = rows.where(complete(usable))
    # Only whether 30 rows exist matters, so the count stops there.
    if rows.limit(MIN_ROWS).count() < MIN_ROWS:
        return rows.withColumn("harmonized", F.lit(False))
    extra = [c for c in rows.columns if c not in features]
    framed, names = _numeric(rows, usable)
    model = fit_site_model(framed, features, site, names, eb=eb)
    raw = framed.withColumns({f"_raw_{f}": F.col(f) for f in features})
    out = model.apply(raw).withColumn("harmonized", ~any_null(features))
    back = {f: F.when(F.col("harmonized"), F.col(f)).otherwise(F.col(f"_raw_{f}")) for f in features}
    return out.withColumns(back).select(*extra, *features, "harmonized")


def _numeric(df: DataFrame, covariates) -> tuple[DataFrame, list[str]]:
    """Covariates as varying numeric columns beside the untouched table."""
    from varve.operators.prep import apply_codes, fit_codes, varying

    kinds, out, names = dict(df.dtypes), df, []
    for c in covariates:
        if kinds[c] == "string":
            out, c = apply_codes(out, fit_codes(df, c), c), f"{c}_code"
        names.append(c)
    return out, varying(out, names)


def prepare_harmonized(
    df: DataFrame, features, target: str, site: str, covariates=(), score_range=None, residualize=(), min_site_n=5, eb=True
) -> DataFrame:
    """Full-sample preparation: target and range filter, residualized target, complete features, site filter, harmonize."""
    rows = target_filter(df, target)
    if score_range is not None:
        rows = range_filter(rows, target, *score_range)
    if residualize:
        framed, names = _numeric(rows, residualize)
        rows = apply_residualizer(framed, fit_residualizer(framed, target, names), target, names)
        rows = rows.drop(*[n for n in names if n.endswith("_code")])
    return harmonize_guarded(rows.where(complete(features)), features, site, covariates, min_site_n, eb)


def paired_harmonized(df: DataFrame, id_col, timepoint, first, second, features, site, covariates=(), target=None, harmonize=True) -> DataFrame:
    """Both visits of each complete pair, harmonized together with the visit as a covariate, side by side."""
    columns = [*features, *([target] if target else [])]
    both = df.where(F.col(timepoint).isin(first, second)).where(complete(columns))
    if harmonize:
        framed, names = _numeric(both.withColumn("_tp", (F.col(timepoint) == second).cast("double")).where(complete([*covariates, site])), covariates)
        both = fit_site_model(framed, features, site, [*names, "_tp"]).apply(framed)
    pairs = paired(both, id_col, timepoint, first, second, columns)
    return pairs.where(complete([f"{f}_{i}" for f in features for i in (1, 2)]))


def harmonize_splits(df: DataFrame, features, site, covariates=(), split="split", eb=True) -> tuple[DataFrame, SiteModel]:
    """Fit on the training split, apply to all of them."""
    train = F.col(split) == "train"
    framed, names = _numeric(df, covariates)
    model = fit_site_model(framed.where(train), features, site, names, eb=eb)
    return model.apply(framed), model


def post_check(df: DataFrame, features, split="split") -> DataFrame:
    """Nulls, min, max and SD of the harmonized values per split."""
    tall = melt(df, [split], features)
    return tall.groupBy(split).agg(
        F.count_if(F.col("value").isNull()).alias("nulls"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("std")
    )


def harmonization_frame(df: DataFrame, keep, site, covariates, train: Column | None = None):
    """Covariate frame for harmonization: SITE, encoded covariates, constants dropped."""
    return covariate_frame(df, keep, site, covariates, train)
