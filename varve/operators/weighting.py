"""Row weights, residualizing, variance filter, scaling and principal components."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from varve.functions.scalars import left_closed_bin
from varve.operators.ols import ols
from varve.operators.shape import melt, top_k
from varve.session import stage, stage_small


def inverse_bin_weights(df: DataFrame, y: str, edges, out="weight") -> DataFrame:
    """n / (bins * rows in bin), bins left-closed and clipped; the bin counts are a table of len(edges) - 1 rows."""
    binned = df.withColumn("_bin", left_closed_bin(F.col(y), edges))
    counts = stage_small(binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_c")))
    total = counts.agg(F.sum("_c").alias("n")).scalar()
    return binned.join(counts, "_bin").withColumn(out, total / (F.lit(len(edges) - 1) * F.col("_c"))).drop("_bin", "_c")


def inverse_value_weights(df: DataFrame, y: str, out="weight") -> DataFrame:
    """1 / count(y), scaled to mean one: the mean of 1/count over rows is distinct values / rows."""
    counts = stage(df.groupBy(y).agg(F.count(F.lit(1)).alias("_c")))
    scale = counts.agg((F.sum("_c") / F.count(F.lit(1))).alias("s")).scalar()
    return df.join(counts, y).withColumn(out, scale / F.col("_c")).drop("_c")


def balanced_class_weights(df: DataFrame, label: str, out="weight") -> DataFrame:
    """n / (classes * rows of the class)."""
    counts = stage_small(df.groupBy(label).agg(F.count(F.lit(1)).alias("_c")))
    scale = counts.agg((F.sum("_c") / F.count(F.lit(1))).alias("s")).scalar()
    return df.join(counts, label).withColumn(out, scale / F.col("_c")).drop("_c")


def runs(df: DataFrame, fold: str, k: int, run="run") -> DataFrame:
    """Every row once per run r = 0..k-1, with `is_train` false where the row's fold is r."""
    return df.withColumn(run, F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("is_train", F.col(fold) != F.col(run))


def fit_residualizer(df: DataFrame, y: str, covariates, groups=()) -> DataFrame:
    """OLS of the target on the covariates: (groups..., term, beta, r2)."""
    return ols(df, y, covariates, groups).select(*groups, "term", "beta", "r2")


def apply_residualizer(df: DataFrame, model: DataFrame, y: str, covariates, groups=(), out=None) -> DataFrame:
    """y minus its fitted value; the model is one small row per group."""
    terms = ["intercept", *covariates]
    wide = model.groupBy(*groups).agg(*[F.max(F.when(F.col("term") == t, F.col("beta"))).alias(f"_b{i}") for i, t in enumerate(terms)])
    wide = stage_small(wide)
    if groups:
        joined = df.join(wide, list(groups))
        beta = [F.col(f"_b{i}") for i in range(len(terms))]
    else:
        joined, beta = df, [wide.select(f"_b{i}").scalar() for i in range(len(terms))]
    fitted = beta[0]
    for b, c in zip(beta[1:], covariates):
        fitted = fitted + b * F.col(c)
    return joined.withColumn(out or y, F.col(y) - fitted).drop(*([f"_b{i}" for i in range(len(terms))] if groups else []))


def feature_variances(df: DataFrame, features, groups=()) -> DataFrame:
    """(groups..., feature, variance); a feature with a null has no variance and so fails the filter."""
    tall = melt(df, groups, features)
    return tall.groupBy(*groups, "feature").agg(
        F.when(F.count_if(F.col("value").isNull()) == 0, F.var_pop("value")).alias("variance")
    )


def live_features(df: DataFrame, features, minimum=1e-10) -> list[str]:
    rows = feature_variances(df, features).where(F.col("variance") > minimum).collect()
    keep = {r["feature"] for r in rows}
    return [f for f in features if f in keep]


def fit_scaler(df: DataFrame, features, groups=()) -> DataFrame:
    """(groups..., feature, mean, sd) with the population SD; a constant feature gets SD 1."""
    tall = melt(df, groups, features)
    m = tall.groupBy(*groups, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return m.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)))


def apply_scaler(df: DataFrame, scaler: DataFrame, features, groups=(), inverse=False) -> DataFrame:
    """Scale (or unscale) wide features.

    With groups, the scaler becomes one small row per group and is joined; without, its two numbers per feature
    become literals of the plan, as in any fitted transformer.
    """
    if groups:
        parts = []
        for i, f in enumerate(features):
            here = F.col("feature") == f
            parts += [F.max(F.when(here, F.col("mean"))).alias(f"_m{i}"), F.max(F.when(here, F.col("sd"))).alias(f"_s{i}")]
        wide = stage_small(scaler.groupBy(*groups).agg(*parts))
        df = df.join(wide, list(groups))
        params = {f: (F.col(f"_m{i}"), F.col(f"_s{i}")) for i, f in enumerate(features)}
    else:
        params = {r["feature"]: (F.lit(r["mean"]), F.lit(r["sd"])) for r in scaler.collect()}
    scaled = {f: F.col(f) * params[f][1] + params[f][0] if inverse else (F.col(f) - params[f][0]) / params[f][1] for f in features}
    out = df.withColumns(scaled)
    return out.drop(*[f"_{x}{i}" for i in range(len(features)) for x in "ms"]) if groups else out


class Components:
    """A fitted principal-component map: model, kept components, explained shares and signed loadings."""

    def __init__(self, model, features, k: int, signs, whiten: bool):
        self.model, self.features, self.k, self.signs, self.whiten = model, features, k, signs, whiten
        self.explained = [float(v) for v in model.explainedVariance.toArray()[:k]]

    def loadings(self, spark) -> DataFrame:
        """(component, feature, loading)."""
        pc = self.model.pc.toArray()
        rows = [(f"PC{j + 1}", f, float(pc[i, j] * self.signs[j])) for j in range(self.k) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "component string, feature string, loading double")

    def transform(self, df: DataFrame, total_variance: float | None = None) -> DataFrame:
        """Adds PC1..PCk to rows with complete features."""
        ready = VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="skip").transform(df)
        out = self.model.transform(ready).withColumn("_a", vector_to_array("_pc"))
        cols = {}
        for j in range(self.k):
            scale = float(self.signs[j])
            if self.whiten:
                scale /= (self.explained[j] * total_variance) ** 0.5
            cols[f"PC{j + 1}"] = F.get("_a", F.lit(j)) * scale
        return out.withColumns(cols).drop("_x", "_pc", "_a")


def fit_pca(df: DataFrame, features, n_components=0.95, whiten=False, min_variance=None) -> Components:
    """Principal components of scaled features: an integer count or a share of variance to reach.

    MLlib sums the covariance with a tree aggregate; only the p x p matrix reaches the driver. Each component's
    sign is fixed by making its largest loading positive. Components below `min_variance` are cut.
    """
    ready = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(df.select(*features))
    share = isinstance(n_components, float) and n_components < 1
    model = PCA(k=len(features) if share else int(n_components), inputCol="_x", outputCol="_pc").fit(ready)
    explained = [float(v) for v in model.explainedVariance.toArray()]
    k = len(explained)
    if share:
        total, k = 0.0, 0
        for v in explained:
            total, k = total + v, k + 1
            if total >= n_components:
                break
    if min_variance is not None:
        k = max(1, sum(v >= min_variance for v in explained[:k]))
    pc = model.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    return Components(model, list(features), k, signs, whiten)


def scree(spark, components: Components) -> DataFrame:
    """(component, explained, cumulative) and, on every row, the components needed for 90 and 95 percent."""
    rows = [(i + 1, v) for i, v in enumerate(components.explained)]
    table = spark.createDataFrame(rows, "component int, explained double")
    run = W.partitionBy(F.lit(0)).orderBy("component").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = table.withColumn("cumulative", F.sum("explained").over(run))
    whole = W.partitionBy(F.lit(0))
    for share in (90, 95):
        out = out.withColumn(f"n_{share}", F.min(F.when(F.col("cumulative") >= share / 100 - 1e-12, F.col("component"))).over(whole))
    return out


def component_importance(loadings: DataFrame, importance: DataFrame, top_components=10, top_features=20) -> DataFrame:
    """Importance of the leading components carried back to features: sum of abs(loading) * importance."""
    lead = top_k(importance, "importance", top_components, "component")
    scored = loadings.join(F.broadcast(lead), "component")  # top_components rows
    summed = scored.groupBy("feature").agg(F.sum(F.abs(F.col("loading")) * F.col("importance")).alias("importance"))
    return top_k(summed, "importance", top_features, "feature")
