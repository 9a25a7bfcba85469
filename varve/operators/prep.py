"""Preparation: recoding, labels, quality control, cohort filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions import scalars as S
from varve.operators.ordering import order_stats
from varve.session import stage, stage_small


def timepoint_split(df: DataFrame, timepoint: str, baseline) -> tuple[DataFrame, DataFrame]:
    """Baseline rows, and the untouched longitudinal table."""
    return df.where(F.col(timepoint) == baseline), df


def recode(df: DataFrame, source: str, output: str, mapping: dict) -> DataFrame:
    return df.withColumn(output, S.value_map(F.col(source), mapping)) if source in df.columns else df


def binning(df: DataFrame, source: str, output: str, thresholds, labels) -> DataFrame:
    return df.withColumn(output, S.right_closed_bin(F.col(source), thresholds, labels)) if source in df.columns else df


def comorbid_group(df: DataFrame, a="anx_group", b="psych_group", output="comorbid_group") -> DataFrame:
    if a not in df.columns or b not in df.columns:
        return df
    return df.withColumn(output, S.comorbid(F.col(a), F.col(b)))


def family_history(df: DataFrame, keys, items: dict[str, list[str]], scope="psychosis", parents=()) -> DataFrame:
    """Any / any parent / count of positive answers for the main topic; `broad` adds one flag per other topic.

    `items` maps topic -> item columns; the first topic is the main one. Text answers are coerced to numbers.
    """
    topics = list(items)
    have = set(df.columns)
    cols = {t: [S.number(F.col(c)) for c in items[t] if c in have] for t in topics}
    main = topics[0]
    out = [
        S.any_equal(cols[main]).alias(f"fhx_{main}_any"),
        S.any_equal([S.number(F.col(c)) for c in parents if c in have]).alias(f"fhx_{main}_parent"),
        S.count_equal(cols[main]).alias(f"fhx_{main}_count"),
    ]
    if scope == "broad":
        out += [S.any_equal(cols[t]).alias(f"fhx_{t}_any") for t in topics[1:] if cols[t]]
    return df.select(*keys, *out)


def quality_control(df: DataFrame, keys, qc: str, maximum: float) -> tuple[DataFrame, DataFrame]:
    """Annotated table and its mask; equality with the maximum passes."""
    if qc not in df.columns:
        raise KeyError(f"QC column {qc!r} not present")
    reason = F.when(F.col(qc).isNull(), "missing_surface_holes").when(F.col(qc) > maximum, "surface_holes_gt_threshold")
    annotated = df.withColumn("qc_reason", reason).withColumn("qc_pass", F.col("qc_reason").isNull())
    return annotated, annotated.select(*keys, qc, "qc_pass", "qc_reason")


def asymmetry_table(df: DataFrame, keep, pairs, ai=True, total=True) -> DataFrame:
    return df.select(*keep, *S.asymmetry_columns(pairs, ai, total))


def lateralization_sets(df: DataFrame, keep, pairs) -> dict[str, DataFrame]:
    """The four representations of bilateral features."""
    raw = list(dict.fromkeys(c for _, l, r in pairs for c in (l, r)))
    return {
        "ai": asymmetry_table(df, keep, pairs, total=False),
        "total": asymmetry_table(df, keep, pairs, ai=False),
        "ai_total": asymmetry_table(df, keep, pairs),
        "raw": df.select(*keep, *raw),
    }


def task_filter(df: DataFrame, group: str, positive, negative, output="y") -> DataFrame:
    """Rows of the positive or negative classes, labelled 1 / 0."""
    pos = [positive] if isinstance(positive, str) else list(positive)
    neg = [negative] if isinstance(negative, str) else list(negative)
    return df.where(F.col(group).isin(pos + neg)).withColumn(output, F.col(group).isin(pos).cast("int"))


def target_filter(df: DataFrame, target: str, sex: str | None = None, required=(), sexes=("male", "female")) -> DataFrame:
    """Target present, binary sex (or unknown), site and covariates present."""
    keep = F.col(target).isNotNull()
    if sex is not None and sex in df.columns:
        keep = keep & (F.col(sex).isNull() | F.col(sex).isin(list(sexes)))
    for c in required:
        if c in df.columns:
            keep = keep & F.col(c).isNotNull()
    return df.where(keep)


def range_filter(df: DataFrame, target: str, low, high) -> DataFrame:
    return df.where(S.in_range(F.col(target), low, high))


def baseline_range_filter(df: DataFrame, id_col, timepoint, baseline, target, low, high) -> DataFrame:
    """All visits of the subjects whose baseline score lies in [low, high)."""
    ids = df.where(F.col(timepoint) == baseline).where(S.in_range(F.col(target), low, high)).select(id_col).distinct()
    return df.join(ids, id_col, "left_semi")


def iqr_filter(df: DataFrame, value: str, k: float = 3.0) -> DataFrame:
    """Rows within k interquartile ranges of the quartiles (exact, linear)."""
    quartiles = order_stats(df, value, [0.25, 0.75])
    bounds = quartiles.agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"),
    )
    span = F.col("q3") - F.col("q1")
    one = stage_small(bounds.select((F.col("q1") - k * span).alias("lo"), (F.col("q3") + k * span).alias("hi")))
    return df.where((F.col(value) >= one.select("lo").scalar()) & (F.col(value) <= one.select("hi").scalar()))


def drop_small_groups(df: DataFrame, group: str, minimum: int) -> DataFrame:
    """Drop rows of groups with fewer than `minimum` rows; rows with a null group are kept."""
    small = stage(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < minimum).select(group))
    return df.join(small, group, "left_anti")


def backfill_from_baseline(df: DataFrame, id_col, timepoint, baseline, substitute: dict[str, str], fill=()) -> DataFrame:
    """Visit rows with `substitute[new]` columns replacing `new`, nulls included, and `fill` columns taken from baseline by id where null.

    The baseline side is one row per id (`max` over the unique baseline row), joined on the id.
    """
    base = df.where(F.col(timepoint) == baseline).groupBy(id_col).agg(*[F.max(c).alias(f"_bl_{c}") for c in fill])
    out = df.join(base, id_col, "left")
    for new, old in substitute.items():
        out = out.withColumn(new, F.col(old))
    for c in fill:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_bl_{c}")))
    return out.drop(*[f"_bl_{c}" for c in fill])


def clip_predictions(df: DataFrame, prediction="yhat", residualized=False) -> DataFrame:
    """Raw scores cannot be negative; residuals can."""
    return df if residualized else df.withColumn(prediction, F.greatest(F.col(prediction), F.lit(0.0)))


def fit_codes(train: DataFrame, col: str) -> DataFrame:
    """Alphabetical 0-based codes of the training categories (a table of distinct values)."""
    from pyspark.sql.window import Window as W

    values = train.where(F.col(col).isNotNull()).select(col).distinct()
    return stage_small(values.withColumn(f"{col}_code", F.row_number().over(W.orderBy(col)) - 1))


def apply_codes(df: DataFrame, codes: DataFrame, col: str) -> DataFrame:
    """Codes by lookup; null and unseen categories get -1."""
    return df.join(codes, col, "left").withColumn(f"{col}_code", F.coalesce(f"{col}_code", F.lit(-1)))


def varying(df: DataFrame, cols) -> list[str]:
    """Columns with at least two distinct non-null values: one min/max aggregate, no distinct."""
    if not cols:
        return []
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def covariate_frame(df: DataFrame, keep, site: str, covariates, train: Column | None = None) -> tuple[DataFrame, list[str]]:
    """SITE plus numeric covariates: strings coded on the training rows, constants dropped."""
    out, names = df, []
    fit_on = df if train is None else df.where(train)
    kinds = dict(df.dtypes)
    for c in covariates:
        if kinds[c] == "string":
            out = apply_codes(out, fit_codes(fit_on, c), c)
            names.append(f"{c}_code")
        else:
            names.append(c)
    live = set(varying(out if train is None else out.where(train), names))
    names = [n for n in names if n in live]
    return out.select(*keep, F.col(site).alias("SITE"), *[F.col(n).cast("double").alias(n) for n in names]), names


def embedding_metadata(df: DataFrame, keys, qc, model, manufacturer, group, age, sex, sex_map: dict) -> DataFrame:
    """Metadata beside an embedding: scanner model with manufacturer fallback, whole-year age, named sex."""
    return df.select(
        *keys,
        F.col(qc).alias("qc"),
        F.coalesce(F.col(model), F.col(manufacturer)).alias("scanner"),
        F.col(group).alias("group"),
        F.col(age).cast("int").alias("age"),
        F.coalesce(S.value_map(F.col(sex), sex_map), F.lit("Unknown")).alias("sex"),
    )


def complete(cols) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols], F.lit(True))
