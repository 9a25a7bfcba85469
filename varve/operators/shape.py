"""Counts, summaries, pivots, top-k and binning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.operators.ordering import order_stats
from varve.session import stage_small


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, columns) -> DataFrame:
    """n, mean, sd, min, max per column over non-null values."""
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "x")
    return tall.groupBy("column").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    )


def family_sizes(df: DataFrame, family: str, subject: str) -> DataFrame:
    """Histogram of family sizes in subjects; one pre-aggregate removes repeated visits."""
    members = df.where(F.col(family).isNotNull()).select(family, subject).distinct()
    return members.groupBy(family).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("families"))


def family_statistics(df: DataFrame, family: str, subject: str) -> DataFrame:
    """(stat, value): families, sibling families and the subjects in them."""
    sizes = family_sizes(df, family, subject)
    sib = F.col("size") > 1
    return sizes.agg(
        F.sum("families").alias("families"),
        F.coalesce(F.sum(F.when(sib, F.col("families"))), F.lit(0)).alias("sibling_families"),
        F.coalesce(F.sum(F.when(sib, F.col("families") * F.col("size"))), F.lit(0)).alias("sibling_subjects"),
    ).unpivot([], ["families", "sibling_families", "sibling_subjects"], "stat", "value")


def crosstab(df: DataFrame, row: str, column: str, levels) -> DataFrame:
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in levels])


def quantile_edges(df: DataFrame, value: str, q: int) -> list[float]:
    """Distinct linear-quantile edges of q equal-frequency bins (q + 1 numbers reach the driver)."""
    rows = order_stats(df, value, [i / q for i in range(q + 1)]).orderBy("prob").collect()
    return sorted({r["value"] for r in rows})


def edge_bin(value, edges):
    """0-based right-closed bin, lowest edge included."""
    index = F.lit(0)
    for e in edges[1:-1]:
        index = index + (value > e).cast("int")
    return F.when(value.isNotNull() & (value >= edges[0]) & (value <= edges[-1]), index)


def quantile_bin(df: DataFrame, value: str, q: int, output="bin") -> DataFrame:
    """Equal-frequency bins with linear edges; duplicate edges collapse."""
    return df.withColumn(output, edge_bin(F.col(value), quantile_edges(df, value, q)))


def tercile_means(df: DataFrame, by: str, value: str, q: int = 3) -> DataFrame:
    binned = quantile_bin(df, by, q)
    return binned.where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
    )


def quantiles(df: DataFrame, value: str, probs, groups=(), accuracy: int | None = None) -> DataFrame:
    """Exact linear quantiles, or one-pass approximate ones when an accuracy is given."""
    if accuracy is None:
        return order_stats(df, value, probs, groups)
    probs = [float(p) for p in probs]
    sketch = F.percentile_approx(value, F.array(*map(F.lit, probs)), accuracy)
    zipped = F.explode(F.arrays_zip(F.array(*map(F.lit, probs)).alias("prob"), F.col("_q").alias("value")))
    return df.groupBy(*groups).agg(sketch.alias("_q")).select(*groups, zipped.alias("_z")).select(*groups, "_z.prob", "_z.value")


def top_k(df: DataFrame, by: str, k: int, tie: str, absolute=False) -> DataFrame:
    key = F.abs(F.col(by)) if absolute else F.col(by)
    return df.orderBy(key.desc(), F.col(tie)).limit(k)


def melt(df: DataFrame, keys, columns, name="feature", value="value") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), name, value)


def best_signed(df: DataFrame, groups, name: str, value: str) -> DataFrame:
    """Entry with the largest absolute value per group, sign kept; ties go to the smaller name."""
    key = F.struct(-F.abs(F.col(value)), F.col(name))
    return df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.min_by(name, key).alias(name), F.min_by(value, key).alias(value))


def top_variance(df: DataFrame, columns, k: int) -> DataFrame:
    tall = melt(df, [], columns)
    return top_k(tall.groupBy("feature").agg(F.var_samp("value").alias("variance")), "variance", k, "feature")


def histogram(df: DataFrame, value: str, bins: int, groups=()) -> DataFrame:
    """Equal-width counts between the column's extremes; the last bin is closed."""
    ends = stage_small(df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    index = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*groups, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def group_means(df: DataFrame, ids: DataFrame, id_col: str, columns, min_n: int = 5) -> DataFrame:
    """Mean and standard error (population SD) of each column over the listed subjects."""
    tall = melt(df.join(ids, id_col, "left_semi"), [], columns)
    out = tall.groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), (F.stddev_pop("value") / F.sqrt(F.count("value"))).alias("se")
    )
    return out.where(F.col("n") >= min_n)


def visit_counts(df: DataFrame, id_col: str, timepoint: str, minimum: int = 2) -> DataFrame:
    return df.groupBy(id_col).agg(F.countDistinct(timepoint).alias("visits")).where(F.col("visits") >= minimum)


def model_comparison(metrics: DataFrame) -> DataFrame:
    """Average balanced accuracy and ROC-AUC and the task count per model, from (model, task, metric, value)."""

    def mean_of(metric):
        return F.avg(F.when(F.col("metric") == metric, F.col("value")))

    return metrics.groupBy("model").agg(
        mean_of("balanced_accuracy").alias("avg_bal_acc"),
        mean_of("roc_auc").alias("avg_roc_auc"),
        F.countDistinct("task").alias("tasks"),
    )


def task_metrics(metrics: DataFrame, names) -> DataFrame:
    """One row per (model, task) with the named metrics as columns; absent metrics are null."""
    return metrics.groupBy("model", "task").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])
