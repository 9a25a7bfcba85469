"""Keyed joins and set operations between cohort tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def label_features(features: DataFrame, dictionary: DataFrame, feature="feature", label="label") -> DataFrame:
    """Left join to the dictionary; a feature without an entry keeps its own name."""
    return features.join(dictionary, feature, "left").withColumn(label, F.coalesce(label, feature))


def match_coefficients(univariate: DataFrame, coefficients: DataFrame, feature="feature") -> DataFrame:
    return univariate.join(coefficients, feature, "inner")


def with_follow_up(df: DataFrame, id_col, timepoint, baseline, follow_up, score, output="score_fu") -> DataFrame:
    """Baseline rows joined to the follow-up score of the same subject."""
    later = df.where(F.col(timepoint) == follow_up).select(id_col, F.col(score).alias(output))
    return df.where(F.col(timepoint) == baseline).join(later, id_col, "inner")


def keep_known(df: DataFrame, other: DataFrame, on, column) -> DataFrame:
    """Left join kept only where the joined column is known, written as the equal inner join."""
    return df.join(other.where(F.col(column).isNotNull()), on, "inner")


def pivot_visits(df: DataFrame, id_col, timepoint, value, visits: dict) -> DataFrame:
    """One row per subject, `value_<name>` per visit; the visit list is explicit, so nothing is collected."""
    return df.where(F.col(timepoint).isin(list(visits.values()))).groupBy(id_col).agg(
        *[F.max(F.when(F.col(timepoint) == v, F.col(value))).alias(f"{value}_{n}") for n, v in visits.items()]
    )


def wide_assembly(df: DataFrame, id_col, timepoint, value, visits: dict, attributes) -> DataFrame:
    """Scores per visit plus baseline attributes, in the one aggregate that the pivot needs anyway."""
    baseline = next(iter(visits.values()))
    return df.where(F.col(timepoint).isin(list(visits.values()))).groupBy(id_col).agg(
        *[F.max(F.when(F.col(timepoint) == v, F.col(value))).alias(f"{value}_{n}") for n, v in visits.items()],
        *[F.max(F.when(F.col(timepoint) == baseline, F.col(a))).alias(a) for a in attributes],
    )


def within(df: DataFrame, ids: DataFrame, on) -> DataFrame:
    return df.join(ids, on, "left_semi")


def without(df: DataFrame, ids: DataFrame, on) -> DataFrame:
    return df.join(ids, on, "left_anti")


def lookup(df: DataFrame, source: DataFrame, key, column, order) -> DataFrame:
    """Fill a column from one row per key of another table."""
    first = source.groupBy(key).agg(F.min_by(column, order).alias("_found"))
    return df.join(first, key, "left").withColumn(column, F.coalesce(column, "_found")).drop("_found")


def common_ids(left: DataFrame, right: DataFrame, id_col) -> DataFrame:
    return left.select(id_col).intersect(right.select(id_col))


def visits_of_all(df: DataFrame, id_col, timepoint, visits) -> DataFrame:
    """Subjects present at every listed visit: one aggregate instead of an intersection of scans."""
    visits = list(visits)
    seen = [F.max((F.col(timepoint) == v).cast("int")) for v in visits]
    hits = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0)) for s in seen])
    return (
        df.where(F.col(timepoint).isin(visits)).groupBy(id_col).agg(hits.alias("_n")).where(F.col("_n") == len(visits)).select(id_col)
    )


def union_all(tables: dict[str, DataFrame], tag: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(tag, F.lit(n)) for n, df in tables.items()])


def first_per_key(df: DataFrame, keys, order, columns) -> DataFrame:
    """First row of each key in a declared order; combines map-side, unlike a row_number window."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    at = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), at).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])


def paired(df: DataFrame, id_col, timepoint, first, second, columns, extra=()) -> DataFrame:
    """Both visits of a subject side by side as `<c>_1`, `<c>_2`, never by position.

    One conditional aggregate replaces a self-join; (id, timepoint) must be unique.
    """
    tp = F.col(timepoint)

    def at(visit, c):
        return F.max(F.when(tp == visit, F.col(c)))

    cols = [at(v, c).alias(f"{c}_{n}") for c in columns for n, v in ((1, first), (2, second))]
    cols += [at(first, c).alias(c) for c in extra]
    both = df.where(tp.isin(first, second)).groupBy(id_col).agg(F.count_if(tp == first).alias("_a"), F.count_if(tp == second).alias("_b"), *cols)
    return both.where((F.col("_a") > 0) & (F.col("_b") > 0)).drop("_a", "_b")


def retained(df: DataFrame, id_col, timepoint, baseline, follow_up, value, columns) -> DataFrame:
    """Baseline rows with a flag: does the subject have the value at follow-up?"""
    tp = F.col(timepoint)
    return (
        df.where(tp.isin(baseline, follow_up))
        .groupBy(id_col)
        .agg(
            F.count_if(tp == baseline).alias("_a"),
            F.count_if((tp == follow_up) & F.col(value).isNotNull()).alias("_b"),
            *[F.max(F.when(tp == baseline, F.col(c))).alias(c) for c in columns],
        )
        .where(F.col("_a") > 0)
        .withColumn("retained", F.col("_b") > 0)
        .drop("_a", "_b")
    )


def visit_index(timepoint: Column, visits) -> Column:
    """Position of the visit in the configured order."""
    out = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(visits))):
        out = F.when(timepoint == v, F.lit(i)).otherwise(out)
    return out
