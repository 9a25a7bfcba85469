"""Nested cross-validated classification with class balancing, tuning, thresholds and calibration."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from varve.models import linear_classifiers as L
from varve.models.fourier import fourier_features, scale_gamma
from varve.models.registry import HAS_PROBABILITY, assemble, classifier, parameter_grid, score_of
from varve.operators import evaluation as V
from varve.operators.combat import _numeric, fit_site_model
from varve.operators.prep import complete, drop_small_groups
from varve.operators.splits import assign_folds, balance_classes, inner_split
from varve.operators.weighting import balanced_class_weights, fit_pca
from varve.session import spread, stage, stage_small

# Thresholds tried when choosing an operating point.
THRESHOLDS = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.60, 0.70)


@dataclass(frozen=True)
class Task:
    """One binary task; `label` is 1 / 0."""

    id: str
    label: str
    features: tuple[str, ...]
    site: str | None = None
    covariates: tuple[str, ...] = ()
    folds: int = 5
    inner_folds: int = 3
    pca: float | int | None = None
    kernel: str = "linear"  # or rbf, through random Fourier features
    iterations: int = 0  # balanced subsets to average over; 0 fits once
    grid: dict = field(default_factory=dict)
    scoring: str = "roc_auc"
    threshold_metric: str = "balanced_accuracy"
    beta: float = 0.5
    thresholds: tuple[float, ...] = THRESHOLDS
    calibrate: bool = False
    seed: int = 42
    params: dict = field(default_factory=dict)
    parallelism: int = 4


def in_parallel(session, fn, items, width: int) -> list:
    """Independent fits as concurrent Spark jobs from a small driver thread pool."""
    items = list(items)
    if width <= 1 or len(items) <= 1:
        return [fn(i) for i in items]
    with ThreadPool(min(width, len(items))) as pool:
        return pool.map(inheritable_thread_target(session)(fn), items)


def folded(df: DataFrame, task: Task) -> tuple[DataFrame, list[str]]:
    """Complete rows with a stratified fold column, written once."""
    needed = dict.fromkeys([task.id, task.label, *task.features, *task.covariates, *([task.site] if task.site else [])])
    rows = stage(df.select(*needed).where(complete(list(needed))))
    names: list[str] = []
    if task.site:
        rows = drop_small_groups(rows, task.site, task.folds)
        rows, names = _numeric(rows, list(task.covariates))
    keep = dict.fromkeys([task.id, task.label, *task.features, *names, *([task.site] if task.site else [])])
    return stage(assign_folds(rows.select(*keep), task.id, task.folds, [task.label], task.seed)), names


def site_model(rows: DataFrame, task: Task, names):
    """Site effects and scales of every run, from one pass of moments per fold."""
    return fit_site_model(with_site(rows, task), task.features, task.site or "_one_site", names, "fold", task.folds, scale=True, harmonize=bool(task.site))


def with_site(rows: DataFrame, task: Task) -> DataFrame:
    return rows if task.site else rows.withColumn("_one_site", F.lit("all"))


def run_frame(rows: DataFrame, task: Task, model, run: int) -> DataFrame:
    """Every row once, with the harmonized and scaled features of one run."""
    mine = with_site(rows, task).withColumns({"run": F.lit(run), "is_train": F.col("fold") != run})
    return model.apply(mine).withColumn("y", F.col(task.label).cast("double"))


def vectorize(frame: DataFrame, task: Task) -> DataFrame:
    """Vector column `x` of one run: components, Fourier features or the features themselves."""
    features = list(task.features)
    if task.pca is not None:
        components = fit_pca(frame.where("is_train"), features, task.pca)
        frame = components.transform(frame)
        features = [f"PC{j + 1}" for j in range(components.k)]
    if task.kernel == "rbf":
        return fourier_features(frame, features, scale_gamma(frame.where("is_train"), features), seed=task.seed)
    return assemble(frame, features)


def as_arrays(df: DataFrame, run: int = 0) -> DataFrame:
    """Rows for the grouped classifiers: `x` as an array, whole-number labels, a `run`."""
    x = vector_to_array("x") if isinstance(df.schema["x"].dataType, VectorUDT) else F.col("x")
    return df.withColumns({"x": x, "y": F.col("y").cast("int"), "run": F.col("run") if "run" in df.columns else F.lit(run)})


def fit_score(name: str, train: DataFrame, test: DataFrame, task: Task, params: dict, keep) -> DataFrame:
    """Scores of one fit on `test`: (keep..., score)."""
    if name in L.LINEAR:
        member = L.Member("", tuple(params.items()))
        coefs = L.fit_members(stage(as_arrays(train)), name, ["run"], [member])
        kept = as_arrays(test.withColumn("_y", F.col("y")) if "y" in keep else test)
        scored = L.score_rows(kept, name, ["run"], coefs, [member], [("_y" if k == "y" else k) for k in keep])
        return scored.select(*[F.col("_y").alias("y") if k == "y" else F.col(k) for k in keep], "score")
    balanced = name == "logistic" and params.get("class_weight", "balanced") == "balanced"
    weight = "weight" if balanced else None
    if balanced:
        train = balanced_class_weights(train, "y")
    size = train.agg(F.count(F.lit(1)).alias("n"), F.first("x").alias("x")).first()
    model = classifier(name, size["x"].size, float(size["n"]), task.seed, weight, **{k: v for k, v in params.items() if v is not None}).fit(train)
    return score_of(model.transform(test), HAS_PROBABILITY[name]).select(*keep, "score")


def inner_folds(train: DataFrame, task: Task, tag: str, groups=()) -> DataFrame:
    """The training rows with a stratified column `inner`, cut once for all settings."""
    return stage(assign_folds(train, [task.id, *groups], task.inner_folds, [*groups, "y"], task.seed, tag, "inner"))


def out_of_fold(name: str, train: DataFrame, task: Task, params: dict, tag: str) -> DataFrame:
    """(id, y, inner, score) for every training row, from inner folds."""
    return _inner_scores(name, inner_folds(train, task, tag), task, params)


def _inner_scores(name: str, rows: DataFrame, task: Task, params: dict) -> DataFrame:
    if name in L.LINEAR:
        members = [L.Member(str(j), tuple(params.items()), j) for j in range(task.inner_folds)]
        ready = stage(as_arrays(rows))
        coefs = L.fit_members(ready, name, ["run"], members, "inner")
        return stage(L.score_rows(ready, name, ["run"], coefs, members, [task.id, "y", "inner"], "inner").drop("member"))

    def fold(j):
        return fit_score(name, rows.where(F.col("inner") != j), rows.where(F.col("inner") == j), task, params, [task.id, "y", "inner"])

    parts = in_parallel(rows.sparkSession, fold, range(task.inner_folds), task.parallelism)
    return stage(reduce(lambda a, b: a.unionByName(b), parts))


def decision_points(name: str, task: Task):
    """Margins are thresholded around zero, probabilities on the configured grid."""
    return (task.thresholds, 0.5) if HAS_PROBABILITY[name] else (tuple(i / 10 for i in range(-10, 11)), 0.0)


def inner_values(scored: DataFrame, name: str, task: Task, groups=()) -> DataFrame:
    """(groups..., value): what the settings of each group are chosen by, from their inner scores."""
    groups = list(groups)
    if task.scoring == "roc_auc":
        return V.roc_auc(scored, "y", "score", [*groups, "inner"]).groupBy(*groups).agg(F.avg("auc").alias("value"))
    if task.scoring == "average_precision":
        return V.average_precision(scored, "y", "score", [*groups, "inner"]).groupBy(*groups).agg(F.avg("ap").alias("value"))
    points, default = decision_points(name, task)
    return V.best_threshold(scored, "y", "score", points, task.scoring, default, groups, task.beta).select(*groups, "value")


def tune(name: str, train: DataFrame, task: Task) -> tuple[dict, list[dict]]:
    """Best parameters by mean inner score, the first maximum winning; and all tried, best first."""
    grid = parameter_grid(task.grid) if task.grid else [{}]
    rows = inner_folds(train, task, "tune")
    if name in L.LINEAR:
        ready = stage(as_arrays(rows))
        scored = _grid_scores(name, ready, task, {**task.params}, grid, [task.id, "run", "y", "inner"])
        values = {r["point"]: r["value"] for r in inner_values(scored, name, task, ["point"]).collect()}
        tried = [{"params": p, "score": values[i]} for i, p in enumerate(grid)]
    else:

        def value(params):
            return inner_values(_inner_scores(name, rows, task, {**task.params, **params}), name, task).first()["value"]

        tried = [{"params": p, "score": value(p)} for p in grid]
    best = max(tried, key=lambda t: t["score"])
    return best["params"], sorted(tried, key=lambda t: -t["score"])


def _grid_scores(name: str, ready: DataFrame, task: Task, params: dict, grid, keep) -> DataFrame:
    """(keep..., point, score) of `ready(run, inner, y, x)`: each setting's out-of-fold scores, and where `inner` is null those of the fit on all training rows.

    All runs, settings and inner folds are fitted together. Rows without `inner` are scored only.
    """
    whole = [None] if ready.where("inner is null").limit(1).count() else []
    members = [
        L.Member(f"{i}|{j}", tuple({**params, **point}.items()), j)
        for i, point in enumerate(grid) for j in [*range(task.inner_folds), *whole]
    ]
    coefs = L.fit_members(ready.where("inner is not null"), name, ["run"], members, "inner")
    scored = L.score_rows(ready, name, ["run"], coefs, members, keep, "inner")
    return stage(scored.withColumn("point", F.substring_index("member", "|", 1).cast("int")).drop("member"))


def fit_platt(scores: DataFrame) -> tuple[float, float] | None:
    """Slope and intercept of a logistic curve on out-of-fold scores; none when a class is absent."""
    curve = L.platt_curves(scores.withColumn("_all", F.lit(0)), ["_all"]).get((0,))
    return None if curve is None else (curve[1], curve[0])


def apply_platt(scores: DataFrame, curve: tuple[float, float] | None) -> DataFrame:
    if curve is None:
        return scores
    return scores.withColumn("score", 1 / (1 + F.exp(-(F.col("score") * curve[0] + curve[1]))))


def ensemble_scores(name: str, ready: DataFrame, task: Task, params: dict) -> tuple[DataFrame, DataFrame]:
    """Mean held-out scores of fits on balanced subsets (run, id, y, score), and each run's threshold from a validation part of its training rows.

    All runs and members are fitted together; the rows of a member are named by a bijection of row numbers, so none is copied.
    """
    train = ready.where("is_train")
    parts = stage(inner_split(train, [task.id, "run"], ["run", "y"], 0.25, task.seed))
    fit_part = L.numbered(parts.where("inner = 'train'").select(task.id, "run", "y", "x"), [task.id, "run"], ["run"], task.seed)
    members = [L.Member(str(i), tuple(params.items()), draw=i) for i in range(task.iterations)]
    coefs = L.fit_members(fit_part, name, ["run"], members, draws=task.iterations, seed=task.seed)
    keep = ["run", task.id, "y", "x"]
    targets = parts.where("inner = 'val'").select(*keep, F.lit(True).alias("_val")).unionByName(ready.where(~F.col("is_train")).select(*keep, F.lit(False).alias("_val")))
    mean = stage(L.mean_scores(targets, name, ["run"], coefs, members, ["run", task.id, "y", "_val"]))
    points, default = decision_points(name, task)
    cuts = V.best_threshold(mean.where("_val"), "y", "score", points, task.threshold_metric, default, ["run"], task.beta)
    return mean.where(~F.col("_val")).select("run", task.id, "y", "score"), stage_small(cuts.select("run", "threshold"))


def balanced_ensemble(name: str, train: DataFrame, test: DataFrame, task: Task, params: dict) -> tuple[DataFrame, float]:
    """Average score of fits on balanced subsets, with the threshold chosen on a validation part."""
    if name in L.LINEAR:
        columns = [task.id, "run", "y", "x"]
        both = as_arrays(train).select(*columns, F.lit(True).alias("is_train")).unionByName(as_arrays(test).select(*columns, F.lit(False).alias("is_train")))
        scores, cuts = ensemble_scores(name, stage(both), task, params)
        return scores.select(task.id, F.col("y").cast("double").alias("y"), "score"), cuts.first()["threshold"]
    parts = stage(inner_split(train, task.id, ["y"], 0.25, task.seed))
    fit_part, val = parts.where("inner = 'train'"), parts.where("inner = 'val'")
    tall = fit_part.select(task.id, "y").withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(task.iterations - 1))))
    picks = stage(balance_classes(tall, [task.id, "iter"], "y", task.seed, groups=["iter"]).select(task.id, "iter"))
    targets = val.select(task.id, "y", "x").withColumn("_val", F.lit(True)).unionByName(test.select(task.id, "y", "x").withColumn("_val", F.lit(False)))

    def member(i):
        rows = fit_part.join(picks.where(F.col("iter") == i), task.id, "left_semi")
        return fit_score(name, rows, targets, task, params, [task.id, "y", "_val"])

    members = in_parallel(train.sparkSession, member, range(task.iterations), task.parallelism)
    scored = reduce(lambda a, b: a.unionByName(b), members)
    mean = stage(scored.groupBy(task.id, "y", "_val").agg(F.avg("score").alias("score")))
    points, default = decision_points(name, task)
    best = V.best_threshold(mean.where("_val"), "y", "score", points, task.threshold_metric, default, (), task.beta).first()
    return mean.where(~F.col("_val")).select(task.id, "y", "score"), best["threshold"]


def linear_predictions(name: str, ready: DataFrame, task: Task, params: dict, grid, calibrate: bool, tag: str) -> tuple[DataFrame, DataFrame]:
    """Held-out predictions (run, id, y, score) of a linear classifier in all runs, and their thresholds (run, threshold).

    Settings, thresholds and calibration curves come from one set of inner folds of each run.
    """
    train = inner_folds(ready.where("is_train"), task, tag, ["run"])
    rows = train.unionByName(ready.where(~F.col("is_train")).withColumn("inner", F.lit(None).cast(dict(train.dtypes)["inner"])))
    rows = stage(spread(rows, ["run", "inner"]))
    scored = _grid_scores(name, rows, task, params, grid, ["run", task.id, "y", "inner"])
    if len(grid) > 1:
        values = inner_values(scored.where("inner is not null"), name, task, ["run", "point"])
        best = values.groupBy("run").agg(F.min_by("point", F.struct(-F.col("value"), F.col("point"))).alias("point"))
        scored = stage(scored.join(stage_small(best), ["run", "point"], "left_semi"))
    inner, held = scored.where("inner is not null"), scored.where("inner is null")
    points, default = decision_points(name, task)
    if calibrate:
        curves = L.platt_curves(inner, ["run"])
        b = lambda i: F.create_map(*[F.lit(v) for key, c in curves.items() for v in (key[0], c[i])])[F.col("run")]
        if curves:
            curve = 1 / (1 + F.exp(-(b(0) + b(1) * F.col("score"))))
            inner, held = (d.withColumn("score", F.coalesce(curve, F.col("score"))) for d in (inner, held))
        points, default = task.thresholds, 0.5
    cuts = V.best_threshold(inner, "y", "score", points, task.threshold_metric, default, ["run"], task.beta)
    return held.select("run", task.id, "y", "score"), stage_small(cuts.select("run", "threshold"))


def run_fold(name: str, frame: DataFrame, task: Task, tag: str) -> tuple[DataFrame, float]:
    """Held-out scores (id, y, score) and the threshold of one run of a classifier without shared passes."""
    train, test = frame.where("is_train"), frame.where(~F.col("is_train"))
    params = dict(task.params)
    if task.grid:
        params.update(tune(name, train, task)[0])
    if task.iterations:
        return balanced_ensemble(name, train, test, task, params)
    inner = out_of_fold(name, train, task, params, tag)
    scores = fit_score(name, train, test, task, params, [task.id, "y"])
    points, default = decision_points(name, task)
    if task.calibrate:
        curve = fit_platt(inner)
        inner, scores = apply_platt(inner, curve), apply_platt(scores, curve)
        points, default = task.thresholds, 0.5
    return scores, V.best_threshold(inner, "y", "score", points, task.threshold_metric, default, (), task.beta).first()["threshold"]


def _labelled(scores: DataFrame, cuts: DataFrame, model: str, task: Task) -> DataFrame:
    """(id, fold, model, y, score, yhat, threshold)"""
    met = scores.join(cuts, "run")
    yhat = (F.col("score") >= F.col("threshold")).cast("int")
    return met.select(task.id, F.col("run").alias("fold"), F.lit(model).alias("model"), F.col("y").cast("double").alias("y"), "score", yhat.alias("yhat"), "threshold")


def nested_cv(df: DataFrame, task: Task, name: str = "svm") -> dict[str, DataFrame]:
    """Out-of-fold predictions of all runs, metrics per model and per fold, beside a logistic baseline.

    Linear classifiers are fitted for all runs, inner folds and settings in shared passes; the others run by run.
    """
    rows, names = folded(df, task)
    model = site_model(rows, task, names)
    spark, k = df.sparkSession, range(task.folds)
    frames = in_parallel(spark, lambda r: stage(vectorize(run_frame(rows, task, model, r), task).select(task.id, "y", "run", "is_train", "x")), k, task.parallelism)
    ready = stage(reduce(lambda a, b: a.unionByName(b), [as_arrays(f) for f in frames]))
    parts = [_labelled(*linear_predictions("logistic", ready, task, {}, [{}], False, "baseline"), "baseline", task)]
    if name not in L.LINEAR:
        runs = in_parallel(spark, lambda r: run_fold(name, frames[r], task, f"model|{r}"), k, task.parallelism)
        scores = reduce(lambda a, b: a.unionByName(b), [s.select(F.lit(r).alias("run"), task.id, "y", "score") for r, (s, _) in enumerate(runs)])
        cuts = spark.createDataFrame([(r, float(c)) for r, (_, c) in enumerate(runs)], "run int, threshold double")
        parts.append(_labelled(stage(scores), cuts, name, task))
    elif task.iterations:
        if task.grid:
            raise ValueError("balanced subsets are fitted with one setting: give params instead of a grid")
        parts.append(_labelled(*ensemble_scores(name, ready, task, dict(task.params)), name, task))
    else:
        grid = parameter_grid(task.grid) if task.grid else [{}]
        parts.append(_labelled(*linear_predictions(name, ready, task, dict(task.params), grid, task.calibrate, "model"), name, task))
    preds = stage(reduce(lambda a, b: a.unionByName(b), parts))
    return {
        "predictions": preds,
        "metrics": V.classification_metrics(preds, "y", "yhat", "score", ["model"]),
        "fold_metrics": V.classification_metrics(preds, "y", "yhat", "score", ["model", "fold"]),
    }


def permutation_importance(df: DataFrame, model, features, id_col: str, repeats=3, seed=42) -> DataFrame:
    """Fall of balanced accuracy when one feature of the scored rows is shuffled; one transform of the exploded rows."""
    from varve.operators.ordering import hash_rank
    from varve.operators.shape import melt

    rows = df.select(id_col, "y", *features)
    donors = melt(hash_rank(rows, id_col, (), seed, "order", "_rank"), ["_rank"], features, "feature", "given")
    tall = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = hash_rank(tall, [id_col, "rep"], ["rep"], seed, "importance", "_rank")
    moved = ranked.withColumn("feature", F.explode(F.array(*map(F.lit, features)))).join(donors, ["_rank", "feature"])
    moved = moved.withColumns({f: F.when(F.col("feature") == f, F.col("given")).otherwise(F.col(f)) for f in features})
    exprs = {"balanced_accuracy": V.rates()["balanced_accuracy"]}
    base = V.tall_metrics(V.confusion(model.transform(assemble(rows, features)), "y", "prediction"), [], exprs).select("value").scalar()
    after = V.tall_metrics(V.confusion(model.transform(assemble(moved, features)), "y", "prediction", ["feature", "rep"]), ["feature", "rep"], exprs)
    drop = after.withColumn("drop", base - F.col("value"))
    return drop.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("importance_std")).orderBy(F.desc("importance"), "feature")


def summary(metrics: DataFrame, task: str) -> DataFrame:
    """Metrics tagged by task, for the model comparison table."""
    return stage_small(metrics.withColumn("task", F.lit(task)))
