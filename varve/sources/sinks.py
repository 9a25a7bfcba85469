"""Run-scoped outputs: datasets, QC, splits, provenance, harmonized matrices and importances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_path(base: str, run_name: str, run_id: str, seed: int, *parts: str) -> str:
    return "/".join([base.rstrip("/"), run_name, run_id, f"seed_{seed}", *parts])


def save_tables(folder: str, include_csv=False, partition_by=None, **tables: DataFrame) -> None:
    """Each table as Parquet, and as CSV where asked for."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{folder}/{name}.parquet")
        if include_csv:
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def save_qc(folder: str, merged: DataFrame, mask: DataFrame, include_csv=False) -> None:
    save_tables(f"{folder}/artifacts/qc", include_csv, merged_raw=merged, qc_mask=mask)


def save_split_map(folder: str, split_map: DataFrame, include_csv=False) -> None:
    save_tables(f"{folder}/artifacts/splits", include_csv, split_map=split_map)


def qc_provenance(mask: DataFrame) -> DataFrame:
    """(kind, name, n): total, pass, fail, and rows per reason with null counted as pass; one aggregate."""
    reasons = mask.groupBy(F.coalesce("qc_reason", F.lit("pass")).alias("name"), "qc_pass").agg(
        F.count(F.lit(1)).alias("n")
    )
    by_reason = reasons.groupBy("name").agg(F.sum("n").alias("n")).select(F.lit("reason").alias("kind"), "name", "n")
    totals = reasons.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("qc_pass"), F.col("n"))), F.lit(0)).alias("pass"),
        F.coalesce(F.sum(F.when(~F.col("qc_pass"), F.col("n"))), F.lit(0)).alias("fail"),
    ).unpivot([], ["total", "pass", "fail"], "name", "n")
    return by_reason.unionByName(totals.select(F.lit("count").alias("kind"), "name", "n"))


def split_provenance(split_map: DataFrame) -> DataFrame:
    return split_map.groupBy(F.col("split").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("split").alias("kind"), "name", "n"
    )


def provenance(mask: DataFrame, split_map: DataFrame) -> DataFrame:
    return qc_provenance(mask).unionByName(split_provenance(split_map))


def save_harmonized(folder: str, df: DataFrame, split="split") -> None:
    """Harmonized rows keyed by id, one Parquet partition per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{folder}/harmonized.parquet")


def load_harmonized(spark: SparkSession, folder: str, splits=None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/harmonized.parquet")
    return df.where(F.col("split").isin(list(splits))) if splits else df


def harmonized_summary(df: DataFrame, features: list[str], split="split", site="site") -> DataFrame:
    """(scope, name, value): site counts per split, the feature count and each feature's variance per split."""
    sites = df.groupBy(split, site).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.concat_ws("/", F.lit("sites"), split).alias("scope"), F.col(site).alias("name"), "value"
    )
    variances = (
        df.unpivot([split], features, "name", "x")
        .groupBy(split, "name")
        .agg(F.var_pop("x").alias("value"))
        .select(F.concat_ws("/", F.lit("variance"), split).alias("scope"), "name", "value")
    )
    size = df.groupBy(split).agg(F.lit(float(len(features))).alias("value")).select(
        F.concat_ws("/", F.lit("features"), split).alias("scope"), F.lit("count").alias("name"), "value"
    )
    return reduce(lambda a, b: a.unionByName(b), [sites, variances, size])


def save_importance(path: str, importance: DataFrame, top: int | None = None) -> None:
    """Importances, largest first, as one CSV (the table has one row per feature)."""
    ranked = importance.orderBy(F.desc("importance"), "feature")
    if top is not None:
        ranked = ranked.limit(top)
    ranked.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
