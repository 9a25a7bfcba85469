"""Missing data: rates, filters, forward fill, attrition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from varve.roles import Settings, prefixed


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, missing, rate), highest rate first; one aggregate over all columns."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    tall = counts.unpivot(["_rows"], df.columns, "column", "missing")
    rate = F.col("missing") / F.greatest(F.col("_rows"), F.lit(1))
    return tall.select("column", "missing", rate.alias("rate")).orderBy(F.desc("rate"), "column")


def any_null(cols) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols], F.lit(False))


def missing_rows(df: DataFrame, columns=None) -> DataFrame:
    return df.where(any_null(columns or df.columns))


def null_rates(df: DataFrame, columns) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns]).first()
    return {c: row[c] or 0.0 for c in columns}


def drop_sparse_columns(df: DataFrame, columns, threshold=0.3) -> tuple[DataFrame, list[str]]:
    """Drop columns whose null rate is above the threshold (strictly)."""
    if not columns:
        return df, []
    rates = null_rates(df, columns)
    sparse = [c for c in columns if rates[c] > threshold]
    return df.drop(*sparse), sparse


def drop_incomplete_rows(df: DataFrame, columns) -> DataFrame:
    return df.dropna("any", subset=list(columns)) if columns else df


def removed_counts(df: DataFrame, stages: dict[str, list[str]]) -> DataFrame:
    """(stage, removed): rows each completeness stage removes, stages applied in order; one aggregate."""
    kept, aggs = F.lit(True), []
    for name, columns in stages.items():
        fails = any_null(columns)
        aggs.append(F.count_if(kept & fails).alias(name))
        kept = kept & ~fails
    return df.agg(*aggs).unpivot([], list(stages), "stage", "removed")


def family_columns(df: DataFrame, settings: Settings) -> dict[str, list[str]]:
    prefixes = dict(settings.prefixes)
    return {f: prefixed(df.columns, prefixes.get(f, ())) for f in settings.families}


def require_metadata(df: DataFrame, required) -> DataFrame:
    """Rows with every required metadata column that exists."""
    return drop_incomplete_rows(df, [c for c in required if c in df.columns])


def require_families(df: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    return drop_incomplete_rows(df, [c for cols in families.values() for c in cols])


def handle_missing(df: DataFrame, settings: Settings, protected=(), drop_rows=True) -> tuple[DataFrame, list[str]]:
    """Required metadata, complete families, sparse columns out, then complete rows.

    Null rates are taken after the first two filters and before any QC filter. Returns the table and the
    dropped columns.
    """
    kept = require_metadata(df, settings.required)
    kept = require_families(kept, family_columns(df, settings))
    safe = set(protected) | {"qc_pass", "qc_reason"}
    candidates = [c for c in kept.columns if c not in safe]
    kept, dropped = drop_sparse_columns(kept, candidates, settings.max_null_rate)
    if drop_rows:
        kept = drop_incomplete_rows(kept, [c for c in candidates if c not in dropped])
    return kept, dropped


def forward_fill(df: DataFrame, id_col: str, order, columns, bucket: Column | None = None) -> DataFrame:
    """Last known value within each subject, in order.

    Without `bucket` one window per subject does it, which suits subjects with few visits. Where a subject may
    hold very many rows, pass a coarse, order-preserving `bucket` of the order: the last value of each bucket is
    carried over the (few) buckets of the subject, and the window runs inside (subject, bucket) only.
    """
    order = [order] if isinstance(order, str) else list(order)
    if bucket is None:
        run = W.partitionBy(id_col).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(run) for c in columns})
    tagged = df.withColumn("_b", bucket)
    at = F.struct(*order)
    lasts = tagged.groupBy(id_col, "_b").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_last_{c}") for c in columns]
    )
    past = W.partitionBy(id_col).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = lasts.select(id_col, "_b", *[F.last(f"_last_{c}", ignorenulls=True).over(past).alias(f"_in_{c}") for c in columns])
    run = W.partitionBy(id_col, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = tagged.join(carry, [id_col, "_b"], "left")
    filled = joined.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(run), F.col(f"_in_{c}")) for c in columns})
    return filled.drop("_b", *[f"_in_{c}" for c in columns])


def attrition(df: DataFrame, group: str, post_qc: Column, final: Column) -> DataFrame:
    """Group sizes before QC, after QC and at the end, with removed percentages; one aggregate."""
    out = df.groupBy(F.col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("pre_qc"), F.count_if(post_qc).alias("post_qc"), F.count_if(final).alias("final")
    )
    pct = lambda a, b: F.round(100.0 * (F.col(a) - F.col(b)) / F.col(a), 2)
    return out.withColumn("removed_qc_pct", pct("pre_qc", "post_qc")).withColumn("removed_total_pct", pct("pre_qc", "final"))
