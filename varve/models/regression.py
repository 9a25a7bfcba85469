"""Nested cross-validated regression: harmonize, residualize, fit and score every fold from shared passes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.functions.scalars import asymmetry_columns
from varve.models import gram as G
from varve.models import tuning as T
from varve.models.registry import assemble, linear_model, regressor, supports_weights
from varve.models.svr import Variant, fit_svr, fit_svr_variants, svr_table
from varve.models.svr_targets import Study, svr_target_scores
from varve.operators import evaluation as V
from varve.operators.combat import _numeric, fit_site_model, site_maps
from varve.operators.prep import complete, drop_small_groups, iqr_filter, range_filter, target_filter
from varve.operators.shape import quantile_bin
from varve.operators.shuffles import number_rows, shuffled_targets
from varve.operators.splits import assign_folds, assign_group_folds, stratification_key
from varve.operators.weighting import apply_scaler, fit_scaler, inverse_bin_weights, inverse_value_weights, runs
from varve.session import spread, stage


@dataclass(frozen=True)
class Spec:
    """What one regression study varies."""

    id: str
    target: str
    features: tuple[str, ...]
    site: str
    covariates: tuple[str, ...] = ()
    residualize: tuple[str, ...] = ()
    covariate_features: tuple[str, ...] = ()
    family: str | None = None
    folds: int = 5
    transform: str = "raw"  # raw, asymmetry, total, ai_total
    pairs: tuple[tuple[str, str, str], ...] = ()
    score_range: tuple[float, float] | None = None
    weight_edges: tuple[float, ...] = ()
    weighting: str = "inverse_freq"  # or inverse_histogram
    outlier_k: float | None = None
    harmonize: bool = True
    eb: bool = True
    seed: int = 42
    models: dict = field(default_factory=dict)

    @property
    def inputs(self) -> list[str]:
        """Names of the model's feature columns."""
        ai, total = [f"{n}_AI" for n, _, _ in self.pairs], [f"{n}_total" for n, _, _ in self.pairs]
        base = {"raw": list(self.features), "asymmetry": ai, "total": total, "ai_total": ai + total}[self.transform]
        return [*base, *self.covariate_features]


def cohort(df: DataFrame, spec: Spec) -> tuple[DataFrame, list[str], list[str]]:
    """Eligible rows with numeric covariates; also the harmonization and residualization covariate names."""
    rows = target_filter(df, spec.target, required=[spec.site, *spec.covariates, *spec.residualize, *spec.covariate_features])
    if spec.score_range is not None:
        rows = range_filter(rows, spec.target, *spec.score_range)
    rows = rows.where(complete(spec.features))
    if spec.outlier_k is not None:
        rows = iqr_filter(rows, spec.target, spec.outlier_k)
    rows = drop_small_groups(rows, spec.site, spec.folds)
    rows, harm = _numeric(rows, list(spec.covariates))
    again = [c for c in spec.residualize if c not in spec.covariates]
    rows, more = _numeric(rows, again)
    coded = {c: (f"{c}_code" if f"{c}_code" in rows.columns else c) for c in spec.residualize}
    resid = [n for n in coded.values() if n in {*harm, *more}]
    return rows, harm, resid


def with_folds(rows: DataFrame, spec: Spec, bins=5, inner=0) -> DataFrame:
    """Fold column: target quintile x site where every cell is large enough, families kept together.

    `inner` folds, if any, are dealt the same way by another hash, once for all outer folds: what is left of them in an outer
    training set splits it again.
    """
    binned = quantile_bin(rows, spec.target, bins, "_bin")
    key, _ = stratification_key(binned, "_bin", spec.site, spec.folds)
    out = binned.withColumn("_key", key)
    for name, k, seed in [("fold", spec.folds, spec.seed), *([("inner", inner, spec.seed + 1)] if inner else [])]:
        if spec.family:
            out = assign_group_folds(out, spec.family, spec.id, "_key", k, seed, name)
        else:
            out = assign_folds(out, spec.id, k, ["_key"], seed, out=name)
    return out.drop("_bin", "_key")


@dataclass
class Prepared:
    """The fold-tagged cohort, written once, with its covariate names."""

    rows: DataFrame
    spec: Spec
    harm: list[str]
    resid: list[str]

    def frame(self, groups=(), spec: Spec | None = None, rows: DataFrame | None = None) -> DataFrame:
        """Every row once per run with that run's harmonized, transformed and scaled features."""
        spec, rows, groups = spec or self.spec, rows if rows is not None else self.rows, list(groups)
        linear = spec.transform == "raw"
        model = fit_site_model(
            rows, spec.features, spec.site, self.harm, "fold", spec.folds, groups, spec.eb, scale=linear, harmonize=spec.harmonize
        )
        tall = model.apply(runs(rows, "fold", spec.folds))
        if not linear:
            ai, total = spec.transform in ("asymmetry", "ai_total"), spec.transform in ("total", "ai_total")
            tall = tall.select("*", *asymmetry_columns(spec.pairs, ai, total))
            tall = tall.drop(*spec.features)
            names = [c for c in spec.inputs if c not in spec.covariate_features]
            keys = [*groups, "run"]
            tall = apply_scaler(tall, fit_scaler(tall.where("is_train"), names, keys), names, keys)
        if spec.covariate_features:
            keys = [*groups, "run"]
            names = list(spec.covariate_features)
            tall = apply_scaler(tall, fit_scaler(tall.where("is_train"), names, keys), names, keys)
        if spec.weight_edges:
            weigh = inverse_value_weights if spec.weighting == "inverse_histogram" else None
            tall = weigh(tall, spec.target) if weigh else inverse_bin_weights(tall, spec.target, spec.weight_edges)
        return tall


def prepare(df: DataFrame, spec: Spec, keep=(), inner=0) -> Prepared:
    """Eligible rows with folds, written once.

    Folds need several passes (quantiles, cell counts, hash cuts), so the input's own joins run once into a narrow
    table first and every pass reads that.
    """
    inputs = dict.fromkeys(
        [spec.id, spec.target, spec.site, *spec.features, *spec.covariates, *spec.residualize, *spec.covariate_features,
         *([spec.family] if spec.family else []), *keep]
    )
    rows, harm, resid = cohort(stage(df.select(*inputs).where(complete([spec.target, *spec.features]))), spec)
    needed = dict.fromkeys(
        [spec.id, spec.target, spec.site, *spec.features, *harm, *resid, *spec.covariate_features, *([spec.family] if spec.family else []), *keep]
    )
    return Prepared(stage(with_folds(rows.select(*needed), spec, inner=inner)), spec, harm, resid)


def _weight(spec: Spec, models) -> str | None:
    return "weight" if spec.weight_edges and all(supports_weights(m, spec.models) for m in models) else None


def fits(prepared: Prepared, frame: DataFrame, models=("ridge",), targets=None, groups=(), drop_each=False, spec=None, block=None) -> DataFrame:
    spec = spec or prepared.spec
    chosen = [linear_model(m, spec.models) for m in models]
    return G.fit_runs(frame, spec.inputs, prepared.resid, targets or [spec.target], chosen, groups, _weight(spec, models), bool(prepared.resid), drop_each, block)


def predict(prepared: Prepared, frame: DataFrame, fitted: DataFrame, groups=(), spec=None) -> DataFrame:
    """Held-out rows: (groups..., id, fold, model, y, yhat), y residualized by its fold's training fit."""
    spec, groups = spec or prepared.spec, list(groups)
    held = frame.where(~F.col("is_train")).where(complete([*spec.inputs, *prepared.resid]))
    small = stage(fitted.where(F.col("target") == spec.target).select(*groups, "run", "model", "coef", "resid"))
    joined = held.join(small, [*groups, "run"])
    cov = prepared.resid if prepared.resid else []
    fitted_y = G.linear_value("coef", spec.inputs)
    if not cov:
        fitted_y = F.greatest(fitted_y, F.lit(0.0))
        y = F.col(spec.target)
    else:
        y = F.col(spec.target) - G.linear_value("resid", cov)
    return joined.select(*groups, spec.id, F.col("run").alias("fold"), "model", y.alias("y"), fitted_y.alias("yhat"))


def additive(spec: Spec) -> bool:
    """Whether a study's linear models follow from sums per fold and site: features enter as they are, and no row has a weight."""
    return spec.transform == "raw" and not spec.covariate_features and not spec.weight_edges


def fold_scores(prepared: Prepared, model="ridge", groups=(), rows: DataFrame | None = None, block: G.Block | None = None, deal=None, more=()) -> DataFrame:
    """(groups..., model, target, pearson_r, r2, mse, n): `pooled` of an `additive` study without a row per run or group.

    Rows are summed once by (groups, fold, site). Every run's site effects, scaling, residuals and fits follow from these sums, as a site
    effect is an affine map of a site's rows. `block` adds targets made within the tasks; with `deal` (see `G.member_gram`) the groups are
    sets of rows, called `member`.
    """
    spec, rows = prepared.spec, rows if rows is not None else prepared.rows
    features, groups = list(spec.features), ["member"] if deal else list(groups)
    columns = [*features, *dict.fromkeys([*prepared.harm, *prepared.resid])]
    known = rows.where(complete([*columns, spec.site, spec.target]))
    # Any constants near the means do.
    mean = prepared.rows.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    shift = np.array([mean[c] or 0.0 for c in columns])
    moved = known.withColumns({c: F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, shift)}).withColumn("_site", F.col(spec.site).cast("string"))
    if deal:
        table = G.member_gram(moved, columns, spec.target, ["fold", "_site"], deal, more)
    else:
        table = G.gram(moved, columns, [spec.target], [*groups, "fold", "_site"], block=block)
    targets = [spec.target, *(block.names if block else [])]
    runs_ = _run_sums(stage(table), prepared, columns, shift, groups, len(targets))
    fitted = G.solve_runs(runs_, features, prepared.resid, targets, [linear_model(model, spec.models)], groups, bool(prepared.resid))
    return G.pooled_r(fitted, groups)


def _run_sums(table: DataFrame, prepared: Prepared, columns, shift, groups, width: int) -> DataFrame:
    """What `G.solve_runs` takes, by (groups, run, side), from cross products by (groups, fold, site) of shifted columns."""
    spec, kinds = prepared.spec, dict(table.dtypes)
    p, head = len(spec.features), 1 + len(columns)
    harm = [1 + columns.index(c) for c in prepared.harm]
    resid = [1 + columns.index(c) for c in prepared.resid]
    mu_x, mu_c = shift[:p], shift[[c - 1 for c in harm]] if harm else np.zeros(0)
    inside, tall = G.pair_places(head, head + 1), G.pair_places(1 + p + len(resid), 1 + p + len(resid) + width)
    names = [*groups, "run", "side", "i", "j", "value"]
    schema = ", ".join([f"`{g}` {kinds[g]}" for g in groups] + ["run int, side string, i int, j int, value double"])

    def read(part: pd.DataFrame) -> G.Moments:
        if "value" in part:
            return G.Moments.read(part, head, head + width)
        values = part[[f"v{i}" for i in range(len(inside[0]))]].to_numpy(float)[0]
        return G.Moments.read(pd.DataFrame({"i": inside[0], "j": inside[1], "value": values}), head, head + 1)

    def total(moments) -> G.Moments | None:
        out = None
        for m in moments:
            out = m if out is None else out + m
        return out

    def maps(train: dict) -> dict:
        """Per site the map from [1, shifted columns] to [1, harmonized and scaled features, covariates]; none for a site without a map."""
        sites = sorted(train)
        xx = np.stack([train[s].xx for s in sites])
        f = np.arange(1, 1 + p)
        slope, const, cov = site_maps(
            xx[:, 0, 0], xx[:, 0, f], xx[:, f, f], xx[:, 0, harm], xx[:, harm][:, :, f], xx[:, harm][:, :, harm], mu_x, mu_c, spec.eb, True, spec.harmonize
        )
        out = {}
        for s, a, b, c in zip(sites, slope, const, cov):
            terms = np.zeros((1 + p + len(resid), head))
            terms[0, 0] = 1.0
            terms[f, f], terms[f, 0] = a, b + a * mu_x + mu_c @ c
            terms[np.ix_(f, harm)] += c.T
            for i, r in enumerate(resid):
                terms[1 + p + i, [0, r]] = shift[r - 1], 1.0
            if not np.isnan(terms).any():
                out[s] = terms
        return out

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cube = {(int(fold), site): read(part) for (fold, site), part in pdf.groupby(["fold", "_site"])}
        cube = {key: m for key, m in cube.items() if m.xx[0, 0] > 0.5}
        parts = [pd.DataFrame({c: [] for c in names})]
        for run in range(spec.folds):
            train = {s: total(m for (f, t), m in cube.items() if f != run and t == s) for s in {t for f, t in cube if f != run}}
            known = maps(train) if train else {}
            sides = {
                "train": total(train[s].mapped(known[s]) for s in known),
                "test": total(m.mapped(known[s]) for (f, s), m in cube.items() if f == run and s in known),
            }
            for side, m in sides.items():
                if m is not None:
                    full, own = np.hstack([m.xx, m.xy]), tall[0] < len(m.xx)
                    values = np.concatenate([full[tall[0][own], tall[1][own]], m.yy])
                    parts.append(pd.DataFrame({"run": run, "side": side, "i": tall[0], "j": tall[1], "value": values}))
        out = pd.concat(parts, ignore_index=True)
        for g in groups:
            out[g] = pdf[g].iloc[0]
        return out[names]

    # One group is one study: (folds x sites x products) numbers.
    keyed = table.groupBy(*groups) if groups else table.withColumn("_all", F.lit(0)).groupBy("_all")
    return stage(keyed.applyInPandas(solve, schema))


def _svr_rows(prepared: Prepared, frame: DataFrame, keys, spec: Spec, base: DataFrame | None = None, keep=()) -> tuple[DataFrame, DataFrame]:
    """All rows with the residual target `_y` and its training mean and SD; and the training rows, staged, with the z-score `_z`."""
    if base is None:
        base = fits(prepared, frame, ["ridge"], groups=[k for k in keys if k != "run"], spec=spec)
    small = stage(base.select(*keys, "resid", "y_mean", "y_sd"))
    y = F.col(spec.target) - (G.linear_value("resid", prepared.resid) if prepared.resid else F.lit(0.0))
    scored = frame.where(complete([*spec.inputs, *prepared.resid])).join(small, keys).withColumn("_y", y)
    z = (F.col("_y") - F.col("y_mean")) / _sd()
    train = scored.where("is_train").select(*keys, *keep, *spec.inputs, "_y", z.alias("_z"))
    return scored, stage(spread(train, [*keys, *keep]))


def _sd():
    return F.when(F.col("y_sd") > 0, F.col("y_sd")).otherwise(F.lit(1.0))


def _svr_results(prepared: Prepared, scored: DataFrame, train: DataFrame, beta: dict, keys, spec: Spec) -> tuple[DataFrame, DataFrame]:
    groups = [k for k in keys if k != "run"]
    table = svr_table(scored.sparkSession, beta, keys, {"without": "int", **dict(train.dtypes)})
    held = scored.where(~F.col("is_train")).join(table, [k for k in keys if k in scored.columns])
    yhat = F.col("y_mean") + _sd() * G.linear_value("svr", spec.inputs)
    if not prepared.resid:
        yhat = F.greatest(yhat, F.lit(0.0))
    preds = held.select(*groups, spec.id, F.col("run").alias("fold"), F.lit("svr").alias("model"), F.col("_y").alias("y"), yhat.alias("yhat"))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.get("svr", F.lit(i + 1)).alias("value")) for i, f in enumerate(spec.inputs)])
    coefs = table.withColumn("_c", F.explode(pairs)).select(*keys, "_c.feature", "_c.value")
    return preds, coefs


def svr_predictions(prepared: Prepared, frame: DataFrame, groups=(), spec=None, **params) -> tuple[DataFrame, DataFrame]:
    """Linear epsilon-SVR on the z-scored residual target, and its coefficients (groups..., run, feature, value)."""
    spec, keys = spec or prepared.spec, [*groups, "run"]
    s = {"C": 1.0, "epsilon": 0.1, **spec.models.get("svr", {}), **params}
    scored, train = _svr_rows(prepared, frame, keys, spec)
    beta = fit_svr(train, spec.inputs, "_z", keys, s["C"], s["epsilon"])
    return _svr_results(prepared, scored, train, beta, keys, spec)


def pooled(prepared: Prepared, frame: DataFrame, model="ridge", groups=(), spec=None) -> DataFrame:
    """(groups..., model, target, pearson_r, r2, mse, n) of one model over all held-out rows; `svr` or a linear model."""
    spec, groups = spec or prepared.spec, list(groups)
    if model != "svr":
        return G.pooled_r(fits(prepared, frame, [model], groups=groups, spec=spec), groups)
    return _pooled_predictions(svr_predictions(prepared, frame, groups, spec)[0], spec, groups)


def svr_without_each(prepared: Prepared, frame: DataFrame, spec=None) -> DataFrame:
    """`pooled` of the SVR with all inputs (`without` 0) and without each of them (1, 2, ...): fits over the same rows, none of which is copied."""
    spec = spec or prepared.spec
    s = {"C": 1.0, "epsilon": 0.1, **spec.models.get("svr", {})}
    scored, train = _svr_rows(prepared, frame, ["run"], spec)
    each = [Variant(str(i), s["C"], s["epsilon"], blank=i or None) for i in range(len(spec.inputs) + 1)]
    found = fit_svr_variants(train, spec.inputs, "_z", ["run"], lambda key: each)
    beta = {(*key, int(name)): b for (key, name), b in found.items()}
    return _pooled_predictions(_svr_results(prepared, scored, train, beta, ["run", "without"], spec)[0], spec, ["without"])


def _pooled_predictions(preds: DataFrame, spec: Spec, groups=()) -> DataFrame:
    p, y = F.col("yhat"), F.col("y")
    sums = preds.groupBy(*groups, "model").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("sp"), F.sum(p * p).alias("spp"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum(p * y).alias("spy")
    )
    return G.pooled_r(sums.withColumn("target", F.lit(spec.target)), groups)


def forest_predictions(prepared: Prepared, frame: DataFrame, spec=None, **params) -> DataFrame:
    """Random-forest regression, one data-parallel fit per run."""
    spec = spec or prepared.spec
    base = stage(fits(prepared, frame, ["ridge"], spec=spec).select("run", "resid"))
    y = F.col(spec.target) - (G.linear_value("resid", prepared.resid) if prepared.resid else F.lit(0.0))
    ready = assemble(frame.where(complete([*spec.inputs, *prepared.resid])).join(base, "run").withColumn("y", y), spec.inputs)
    ready = stage(ready.select(spec.id, "run", "is_train", "y", "x", *(["weight"] if spec.weight_edges else [])))
    out = None
    for r in range(spec.folds):
        run = ready.where(F.col("run") == r)
        model = regressor("random_forest_regressor", spec.seed + r, "weight" if spec.weight_edges else None, **{**spec.models.get("random_forest_regressor", {}), **params}).fit(run.where("is_train"))
        part = model.transform(run.where(~F.col("is_train"))).select(
            spec.id, F.col("run").alias("fold"), F.lit("random_forest").alias("model"), "y", F.col("prediction").alias("yhat")
        )
        out = part if out is None else out.unionByName(part)
    return out


def tuned(prepared: Prepared, frame: DataFrame, grid: dict, scoring="neg_mae") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Choices (run, model, candidate, place, score), the chosen linear fits under their model's name, and SVR predictions if `grid` has svr.

    `grid` is {model: {setting: values}}; `prepared` and the staged `frame` have inner folds. As in the studied pipeline, features and the
    residual target are those of the outer training set, and a tuned model is fitted without row weights.
    """
    spec = prepared.spec
    table = stage(G.run_table(frame, spec.inputs, prepared.resid, [spec.target], (), None, part="inner"))
    whole = table.groupBy("run", "side", "i", "j").agg(F.sum("value").alias("value"))
    candidates = T.linear_candidates(grid, spec.models)
    plain = [m for points in candidates.values() for _, m in points]
    fitted = stage(G.solve_runs(whole, spec.inputs, prepared.resid, [spec.target], plain or [linear_model("ridge")], (), bool(prepared.resid)))
    # Residual terms and target moments are the same for every model.
    scored, train = _svr_rows(prepared, frame, ["run"], spec, fitted.dropDuplicates(["run"]), ["inner"])
    sums = None
    if candidates:
        sums = stage(T.inner_fits(table, spec.inputs, prepared.resid, candidates, (), bool(prepared.resid)))
        if scoring == "neg_mae":
            coefs: dict = {}
            for r in sums.select("run", "inner", "model", "candidate", "place", "coef").collect():  # runs x inner folds x candidates
                coefs.setdefault(((r.run,), r.inner), []).append((r.model, r.candidate, r.place, r.coef))
            sums = T.score_rows(train, spec.inputs, "_y", ["run"], "inner", coefs)
        sums = sums.drop("coef")
    if "svr" in grid:
        points = T.svr_candidates(grid, spec.models)
        parts = [r[0] for r in train.select("inner").distinct().collect()]
        found = fit_svr_variants(train, spec.inputs, "_z", ["run"], T.svr_variants(points, parts), "inner")
        coefs = {}
        for (key, name), b in found.items():
            place, inner = map(int, name.split("|"))
            coefs.setdefault((key, inner), []).append(("svr", points[place][0], place, b))
        more = T.score_rows(train, spec.inputs, "_z", ["run"], "inner", coefs)
        columns = more.columns if sums is None or "sae" in sums.columns else sums.columns
        sums = more if sums is None else sums.unionByName(more.select(*columns))
    choices = stage(T.choose(sums, ["run"], scoring))
    names = {m.name: name for name, points in candidates.items() for _, m in points}
    to_name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    best = None
    if candidates:
        picked = choices.where("model <> 'svr'").select("run", F.concat("model", F.lit("["), "candidate", F.lit("]")).alias("model"))
        best = fitted.join(picked, ["run", "model"]).withColumn("model", to_name[F.col("model")])
    preds = None
    if "svr" in grid:
        chosen = {(r.run,): [Variant("", *points[r.place][1:])] for r in choices.where("model = 'svr'").collect()}
        beta = fit_svr_variants(train, spec.inputs, "_z", ["run"], chosen.get)
        preds = _svr_results(prepared, scored, train, {key: b for (key, _), b in beta.items()}, ["run"], spec)[0]
    return choices, best if best is not None else fitted.limit(0), preds


def nested_cv(df: DataFrame, spec: Spec, models=("ridge",), svr=False, forest=False, grid=None, inner_folds=3, scoring="neg_mae") -> dict[str, DataFrame]:
    """Predictions, pooled and per-fold metrics, coefficients and residualizer terms of all models over the same folds.

    With `grid` ({model: {setting: values}}, of linear models and `svr`), the models it names have their settings chosen in each outer training set by
    `inner_folds` inner folds and `scoring` ("neg_mae", "neg_mse" or "pearson_r"); `choices` tells which.
    """
    prepared = prepare(df, spec, inner=inner_folds if grid else 0)
    frame = stage(prepared.frame())
    plain = [m for m in models if m not in (grid or {})]
    # The residualizer's terms come with a linear model; without one they are those of ridge.
    fitted = fits(prepared, frame, plain or ("ridge",))
    out = {}
    kept = fitted if plain else fitted.limit(0)
    preds = None
    if grid:
        out["choices"], best, preds = tuned(prepared, frame, grid, scoring)
        kept = kept.unionByName(best)
    kept = stage(kept)
    linear = predict(prepared, frame, kept)
    preds = linear if preds is None else linear.unionByName(preds)
    if svr and "svr" not in (grid or {}):
        preds = preds.unionByName(svr_predictions(prepared, frame)[0])
    if forest:
        preds = preds.unionByName(forest_predictions(prepared, frame))
    preds = stage(preds)
    return {
        **out,
        "predictions": preds,
        "metrics": V.regression_metrics(preds, "y", "yhat", ["model"], ranks=False),
        "fold_metrics": V.regression_metrics(preds, "y", "yhat", ["model", "fold"], ranks=False),
        "coefficients": G.coefficients(kept, spec.inputs),
        "residual_terms": G.residual_terms(fitted if not grid else kept.unionByName(fitted), prepared.resid),
    }


def compare_feature_sets(df: DataFrame, spec: Spec, sets=("raw", "asymmetry", "total", "ai_total"), model="ridge") -> DataFrame:
    """Pooled r of each feature representation over identical folds."""
    prepared = prepare(df, spec)
    out = None
    for name in sets:
        variant = replace(spec, transform=name)
        frame = prepared.frame(spec=variant)
        part = pooled(prepared, frame, model, spec=variant).withColumn("feature_set", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.drop("target")


def permutation_null(df: DataFrame, spec: Spec, perms: int, model="ridge", groups=(), alternative="two-sided") -> tuple[DataFrame, DataFrame]:
    """Pooled r of the real target and of `perms` shuffles of it under the same folds and harmonization.

    Targets are shuffled within `groups`. The shuffles are extra targets of one cross-product pass, made in its tasks by a bijection of row numbers:
    features, folds and site effects are shared, and no row is shuffled or copied for them. For `svr` they are targets of fits over the same rows.
    Returns (groups..., draw, pearson_r) and (groups..., observed, p).
    """
    groups = list(groups)
    prepared = prepare(df, spec, keep=groups)
    rows = prepared.rows
    numbered, block = shuffled_targets(number_rows(rows, spec.id, groups, spec.seed), spec.target, perms, spec.seed)
    if model == "svr":
        return _against_null(stage(_svr_of_targets(prepared, numbered, block, groups)), spec.target, groups, alternative)
    if additive(spec):
        return _against_null(stage(fold_scores(prepared, model, groups, numbered, block)), spec.target, groups, alternative)
    frame = prepared.frame(groups, rows=numbered)
    scores = stage(G.pooled_r(fits(prepared, frame, [model], [spec.target], groups, block=block), groups))
    return _against_null(scores, spec.target, groups, alternative)


def _svr_of_targets(prepared: Prepared, numbered: DataFrame, block: G.Block, groups) -> DataFrame:
    """`pooled` of the SVR for the real target and those of `block`, all over the rows of one frame."""
    spec = prepared.spec
    s = {"C": 1.0, "epsilon": 0.1, **spec.models.get("svr", {})}
    # Features and targets meet by id.
    given = numbered.select(spec.id, spec.target, *block.columns, (F.col("_base") + F.col("_slot")).alias("_place"))
    rows = prepared.frame(groups).drop(spec.target).join(given.hint("merge"), spec.id)
    study = Study(rows, (*groups, "run"), tuple(spec.inputs), tuple(prepared.resid), spec.target, block, "_place", s["C"], s["epsilon"])
    return G.pooled_r(svr_target_scores(study, floor=not prepared.resid), groups)


def _against_null(scores: DataFrame, target: str, groups, alternative) -> tuple[DataFrame, DataFrame]:
    null = scores.where(F.col("target") != target).select(*groups, F.col("target").alias("draw"), "pearson_r")
    seen = scores.where(F.col("target") == target).select(*groups, F.col("pearson_r").alias("observed"))
    both = null.join(seen, groups) if groups else null.withColumn("observed", seen.scalar())
    hit = F.abs("pearson_r") >= F.abs("observed") if alternative == "two-sided" else F.col("pearson_r") >= F.col("observed")
    p = both.groupBy(*groups, "observed").agg(((1 + F.count_if(hit)) / (1 + F.count(F.lit(1)))).alias("p"), F.avg("pearson_r").alias("null_mean"), F.stddev_pop("pearson_r").alias("null_sd"))
    return null, p


def permutation_importance(prepared: Prepared, frame: DataFrame, fitted: DataFrame, repeats=3) -> DataFrame:
    """(feature, importance, within_sd, between_sd): fall of r2 when a held-out feature is shuffled.

    A shuffled value is another row's value of the same run, met by equal hash ranks; all features and repeats are
    scored by one pass over the exploded held-out rows.
    """
    spec = prepared.spec
    held = frame.where(~F.col("is_train")).where(complete([*spec.inputs, *prepared.resid]))
    small = stage(fitted.where(F.col("target") == spec.target).select("run", "coef", "resid"))
    y = F.col(spec.target) - (G.linear_value("resid", prepared.resid) if prepared.resid else F.lit(0.0))
    scored = held.join(small, "run").select(spec.id, "run", y.alias("y"), G.linear_value("coef", spec.inputs).alias("yhat"), "coef", *spec.inputs)
    scored = stage(scored)
    return importance_from_scores(scored, spec.id, spec.inputs, repeats, spec.seed)


def importance_from_scores(scored: DataFrame, id_col: str, features, repeats: int, seed=42) -> DataFrame:
    from varve.operators.ordering import hash_rank
    from varve.operators.shape import melt

    donors = hash_rank(scored, [id_col], ["run"], seed, "order", "_rank")
    values = melt(donors, ["run", "_rank"], features, "feature", "given")
    tall = scored.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    receivers = hash_rank(tall, [id_col, "rep"], ["run", "rep"], seed, "importance", "_rank")
    own = receivers.select("run", "rep", "_rank", "y", "yhat", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"), F.get("coef", F.lit(i + 1)).alias("b")) for i, f in enumerate(features)
    ])).alias("_f")).select("run", "rep", "_rank", "y", "yhat", "_f.feature", "_f.x", "_f.b")
    moved = own.join(values, ["run", "_rank", "feature"]).withColumn("shifted", F.col("yhat") + F.col("b") * (F.col("given") - F.col("x")))
    base = V.tall_metrics(V.regression_sums(scored, "y", "yhat", ["run"]), ["run"], {"r2": V.regression_exprs()["r2"]}).select("run", F.col("value").alias("r2"))
    after = V.tall_metrics(V.regression_sums(moved, "y", "shifted", ["run", "rep", "feature"]), ["run", "rep", "feature"], {"r2": V.regression_exprs()["r2"]})
    drop = after.join(base, "run").withColumn("drop", F.col("r2") - F.col("value"))
    per_fold = drop.groupBy("run", "feature").agg(F.avg("drop").alias("m"), F.stddev_pop("drop").alias("s"))
    return per_fold.groupBy("feature").agg(F.avg("m").alias("importance"), F.avg("s").alias("within_sd"), F.stddev_pop("m").alias("between_sd")).orderBy(F.desc("importance"), "feature")
