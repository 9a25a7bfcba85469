"""Scans: CSV and Parquet inputs, visit defaults and the N-way merge on (subject, visit)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from varve.functions.scalars import finite


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column, once, at the edge."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            F.when(finite(F.col(c)), F.col(c)).alias(c) if isinstance(t, (DoubleType, FloatType)) else F.col(c)
            for c, t in kinds.items()
        ]
    )


def read_csv(spark: SparkSession, path, columns=None, schema: StructType | None = None, encoding="UTF-8") -> DataFrame:
    """CSV with a header, pruned to the wanted columns that exist; a byte-order mark on the header is stripped.

    Pass `schema` for large inputs: inference costs one more scan of the file.
    """
    reader = spark.read.option("header", True).option("encoding", encoding)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    first = df.columns[0]
    if first.startswith("﻿"):
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    if columns is not None:
        have = set(df.columns)
        df = df.select(*[c for c in columns if c in have])
    return nulls_for_nan(df)


def read_parquet(spark: SparkSession, path, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    return nulls_for_nan(df.select(*columns) if columns is not None else df)


def read_splits(spark: SparkSession, folder: str, names=("train", "val", "test")) -> DataFrame:
    """Train, validation and test tables as one, tagged by split."""
    parts = [read_parquet(spark, f"{folder}/{n}.parquet").withColumn("split", F.lit(n)) for n in names]
    return reduce(lambda a, b: a.unionByName(b), parts)


def with_visit(df: DataFrame, timepoint: str, baseline) -> DataFrame:
    """Baseline-only inputs carry no visit column: add it as a constant."""
    return df if timepoint in df.columns else df.withColumn(timepoint, F.lit(baseline))


def merge_all(inputs: list[DataFrame], keys: list[str], baseline, visits=None) -> DataFrame:
    """Full outer merge of all inputs on the keys.

    A chain of full outer joins re-shuffles the growing result at every step, and a later filter on the visit
    stays above it. Here the visit filter is applied to each scan, the distinct keys form a spine, and every
    input is left-joined to it: the spine keeps its partitioning, so each input is shuffled once. Rows with a
    null key match nothing and are dropped; a column present in two inputs is an error.
    """
    timepoint = keys[-1]
    ready = []
    for df in inputs:
        df = with_visit(df, timepoint, baseline)
        if visits is not None:
            df = df.where(F.col(timepoint).isin(list(visits)))
        ready.append(df.dropna("any", subset=keys))
    seen: set[str] = set()
    for df in ready:
        extra = set(df.columns) - set(keys)
        if extra & seen:
            raise ValueError(f"columns in more than one input: {sorted(extra & seen)}")
        seen |= extra
    spine = reduce(lambda a, b: a.unionByName(b), [df.select(*keys) for df in ready]).distinct()
    return reduce(lambda left, df: left.join(df, keys, "left"), ready, spine)


def null_key_counts(inputs: list[DataFrame], keys: list[str]) -> list[DataFrame]:
    """Rows each input loses in `merge_all` because a key is null."""
    lost = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return [df.agg(F.count_if(lost).alias("null_key_rows")) for df in inputs]


def read_dictionary(spark: SparkSession, path) -> DataFrame:
    """Data dictionary: variable name and label."""
    df = read_csv(spark, path)
    return df.select(F.col("var_name").alias("feature"), F.col("var_label").alias("label"))
