"""Exact order-dependent operators without a single-task window.

A window over a whole table, or over one hot stratum, runs in one task. Everything here first cuts the order
into many buckets, aggregates per bucket (map-side combined), and then either touches only the buckets that
hold a wanted position (`hash_parts`, `order_stats`) or adds a per-bucket offset (`hash_rank`, `running_sums`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from varve.functions.hashing import hash_key
from varve.session import stage, stage_small

HASH_DIGITS = 4  # 16^4 buckets per stratum
SUB_BUCKETS = 4096


def _stratum(strata) -> Column:
    if not strata:
        return F.lit("all")
    return F.concat_ws("\u0001", *[F.coalesce(F.col(s).cast("string"), F.lit("unknown")) for s in strata])


def hash_parts(df: DataFrame, ids, limits, strata=(), seed=42, tag="part", out="part", digits=HASH_DIGITS) -> DataFrame:
    """Cut each stratum, in hash order, at exact ranks.

    `limits(n)` gives ascending cumulative ranks for a stratum of n rows; `out` is how many of them lie below
    the row's rank. Rows are not shuffled: one aggregate counts hash prefixes, one filtered pass finds the row
    at each limit, and the result compares every row with those few edge rows. `ids` must be unique.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    keyed = df.withColumn("_s", _stratum(strata)).withColumn("_h", hash_key(ids, seed, tag))
    bucket = F.substring("_h", 1, digits)
    by_bucket = W.partitionBy("_s").orderBy("_b")
    counts = (
        keyed.groupBy("_s", bucket.alias("_b"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_cum", F.sum("_c").over(by_bucket))
        .withColumn("_n", F.sum("_c").over(W.partitionBy("_s")))
    )
    wanted = F.array(*[F.struct(F.lit(j).alias("j"), k.cast("long").alias("k")) for j, k in enumerate(limits(F.col("_n")))])
    low = F.col("_cum") - F.col("_c")
    marks = stage(
        counts.withColumn("_w", F.explode(wanted))
        .where(((F.col("_w.k") > low) & (F.col("_w.k") <= F.col("_cum"))) | ((F.col("_w.k") <= 0) & (low == 0)))
        .select("_s", "_b", F.col("_w.j").alias("_j"), F.greatest(F.col("_w.k") - low, F.lit(0)).alias("_r"))
    )
    edge = F.struct(F.col("_h").alias("h"), *[F.col(i).alias(f"i{n}") for n, i in enumerate(ids)])
    within = W.partitionBy("_s", "_b", "_j").orderBy("_h", *ids)
    found = (
        keyed.select("_s", "_h", *ids, bucket.alias("_b"))
        .join(marks.where("_r > 0"), ["_s", "_b"])
        .withColumn("_row", F.row_number().over(within))
        .where("_row = _r")
        .select("_s", edge.alias("_e"))
    )
    edges = stage_small(found.groupBy("_s").agg(F.sort_array(F.collect_list("_e")).alias("_edges")))
    zeros = marks.where("_r = 0").groupBy("_s").agg(F.count(F.lit(1)).alias("_z"))
    keyed = keyed.join(edges, "_s", "left")
    beyond = F.coalesce(F.size(F.filter("_edges", lambda e: edge > e)), F.lit(0))
    keyed = keyed.withColumn(out, F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(beyond))
    zero_rows = stage_small(zeros)
    keyed = keyed.join(zero_rows, "_s", "left").withColumn(out, (F.col(out) + F.coalesce("_z", F.lit(0))).cast("int"))
    return keyed.drop("_s", "_h", "_edges", "_z")


def hash_rank(df: DataFrame, ids, strata=(), seed=42, tag="rank", out="rank", digits=HASH_DIGITS) -> DataFrame:
    """Exact 1-based rank in hash order within each stratum; one shuffle on (stratum, hash prefix).

    The rows meet their offsets by a merge: Spark's estimate for rows that were multiplied before is that of the table they come from,
    and the offsets are as many as strata x prefixes, so neither side may be broadcast on an estimate. The window needs the same shuffle.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    keyed = (
        df.withColumn("_s", _stratum(strata))
        .withColumn("_h", hash_key(ids, seed, tag))
        .withColumn("_b", F.substring("_h", 1, digits))
    )
    offsets = (
        keyed.groupBy("_s", "_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_off", F.sum("_c").over(W.partitionBy("_s").orderBy("_b")) - F.col("_c"))
        .drop("_c")
    )
    within = W.partitionBy("_s", "_b").orderBy("_h", *ids)
    return (
        keyed.join(offsets.hint("merge"), ["_s", "_b"])
        .withColumn(out, F.col("_off") + F.row_number().over(within))
        .drop("_s", "_h", "_b", "_off")
    )


def _grouped(df: DataFrame, groups) -> tuple[DataFrame, list[str]]:
    if groups:
        return df, list(groups)
    return df.withColumn("_g", F.lit(0)), ["_g"]


def _same(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Null-safe inner join on `keys`, keeping the left key columns."""
    renamed = right.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"_k_{k}"])
    return left.join(renamed, cond).drop(*[f"_k_{k}" for k in keys])


def bucket_count(df: DataFrame) -> int:
    """Value buckets per group: about eight per shuffle partition, a power of two within 64..8192."""
    wanted = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << (max(64, min(8192, wanted)).bit_length() - 1)


def splitters(df: DataFrame, value: str, groups) -> DataFrame:
    """Per group: row count and approximate equal-count splitters, staged so every later pass sees the same."""
    buckets = bucket_count(df)
    points = F.expr("array(" + ",".join(f"{i / buckets!r}D" for i in range(1, buckets)) + ")")
    return stage(
        df.groupBy(*groups).agg(
            F.array_distinct(F.percentile_approx(value, points, 10 * buckets)).alias("_sp"),
            F.count(value).alias("_n"),
        )
    )


def _locate(buckets: int) -> Column:
    """Number of joined splitters `_sp` below the value `_v`, by bisection (log2 steps inside one fold)."""
    steps = F.array(*[F.lit(2**k) for k in reversed(range(buckets.bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda low, w: F.when(F.get("_sp", low + w - 1) < F.col("_v"), low + w).otherwise(low)
    )


def order_stats(df: DataFrame, value: str, probs, groups=()) -> DataFrame:
    """Exact linear-interpolation quantiles: one row (group..., prob, value) per group and probability.

    Counts per bucket locate the bucket holding each wanted position; only those buckets are read again, and
    inside them equal values are collapsed before they are ordered. Null values are ignored.
    """
    base, keys = _grouped(df.where(F.col(value).isNotNull()), groups)
    base = base.select(*keys, F.col(value).cast("double").alias("_v"))
    cut = splitters(base, "_v", keys)
    bucketed = _same(base, cut, keys).withColumn("_b", _locate(bucket_count(df))).select(*keys, "_b", "_v")
    marks = _find_marks(bucketed, cut, keys, probs)
    bucketed, marks = _refine(bucketed, marks, keys)
    hit = _same(bucketed, marks.select(*keys, "_b").distinct(), [*keys, "_b"])
    distinct = hit.groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_m"))
    run = W.partitionBy(*keys, "_b").orderBy("_v")
    placed = distinct.withColumn("_hi", F.sum("_m").over(run)).withColumn("_lo", F.col("_hi") - F.col("_m"))
    inside = (F.col("_pos") >= F.col("_lo")) & (F.col("_pos") < F.col("_hi"))
    picked = _same(placed, marks.withColumnRenamed("_c", "_bc"), [*keys, "_b"]).where(inside)
    low = F.max(F.when(F.col("_side") == 0, F.col("_v")))
    high = F.max(F.when(F.col("_side") == 1, F.col("_v")))
    out = picked.groupBy(*keys, F.col("_p").alias("prob")).agg(
        (low + (high - low) * F.max("_frac")).alias("value")
    )
    return out if groups else out.drop("_g")


def _find_marks(bucketed: DataFrame, cut: DataFrame, keys, probs) -> DataFrame:
    counts = bucketed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_cum", F.sum("_c").over(W.partitionBy(*keys).orderBy("_b")))
    wants = []
    for p in probs:
        at = (F.col("_n") - 1) * F.lit(float(p))
        for side in (0, 1):
            wants.append(
                F.struct(
                    F.lit(float(p)).alias("p"),
                    F.lit(side).alias("side"),
                    F.least(F.floor(at) + side, F.col("_n") - 1).cast("long").alias("at"),
                    (at - F.floor(at)).alias("frac"),
                )
            )
    wanted = cut.where("_n > 0").withColumn("_w", F.explode(F.array(*wants))).select(*keys, "_w")
    start = F.col("_cum") - F.col("_c")
    joined = _same(counts, wanted, keys).where((F.col("_w.at") >= start) & (F.col("_w.at") < F.col("_cum")))
    return stage_small(
        joined.select(
            *keys,
            "_b",
            "_c",
            F.col("_w.p").alias("_p"),
            F.col("_w.side").alias("_side"),
            F.col("_w.frac").alias("_frac"),
            (F.col("_w.at") - start).alias("_pos"),
        )
    )


def _refine(bucketed: DataFrame, marks: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """Cut every boundary bucket linearly into sub-buckets and move the marks into them."""
    on = [*keys, "_b"]
    hit = _same(bucketed, marks.select(*on).distinct(), on)
    spans = stage_small(hit.groupBy(*on).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max")))
    part = F.when(
        F.col("_max") > F.col("_min"),
        F.least(F.floor((F.col("_v") - F.col("_min")) / (F.col("_max") - F.col("_min")) * SUB_BUCKETS), F.lit(SUB_BUCKETS - 1)),
    ).otherwise(F.lit(0))
    fine = _same(hit, spans, on).select(*keys, (F.col("_b") * SUB_BUCKETS + part.cast("long")).alias("_f"), "_b", "_v")
    counts = fine.groupBy(*on, "_f").agg(F.count(F.lit(1)).alias("_fc"))
    counts = counts.withColumn("_cum", F.sum("_fc").over(W.partitionBy(*on).orderBy("_f")))
    start = F.col("_cum") - F.col("_fc")
    moved = _same(counts, marks, on).where((F.col("_pos") >= start) & (F.col("_pos") < F.col("_cum")))
    marks = moved.select(*keys, F.col("_f").alias("_b"), F.col("_fc").alias("_c"), "_p", "_side", "_frac", (F.col("_pos") - start).alias("_pos"))
    return fine.select(*keys, F.col("_f").alias("_b"), "_v"), stage_small(marks)


def running_sums(df: DataFrame, order: str, sums, groups=(), descending=False) -> DataFrame:
    """Inclusive running totals `cum_<c>` and group totals `tot_<c>` over the distinct `order` values of each group.

    `df` holds one row per (group, order) value. Rows are bucketed by splitters of the order column, each bucket
    is windowed on its own, and the totals of the buckets before it are added.
    """
    base, keys = _grouped(df, groups)
    cut = splitters(base.withColumn("_v", F.col(order).cast("double")), "_v", keys)
    rows = _same(base.withColumn("_v", F.col(order).cast("double")), cut.drop("_n"), keys).withColumn("_b", _locate(bucket_count(df)))
    rows = rows.drop("_sp")
    turn = F.desc if descending else F.asc
    per_bucket = rows.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = W.partitionBy(*keys).orderBy(turn("_b")).rowsBetween(W.unboundedPreceding, W.currentRow)
    for c in sums:
        per_bucket = per_bucket.withColumn(f"_o_{c}", F.sum(f"_t_{c}").over(before) - F.col(f"_t_{c}"))
        per_bucket = per_bucket.withColumn(f"tot_{c}", F.sum(f"_t_{c}").over(W.partitionBy(*keys)))
    per_bucket = per_bucket.drop(*[f"_t_{c}" for c in sums])
    within = W.partitionBy(*keys, "_b").orderBy(turn(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = _same(rows, per_bucket, [*keys, "_b"])
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(within) + F.col(f"_o_{c}"))
    out = out.drop("_v", "_b", *[f"_o_{c}" for c in sums])
    return out if groups else out.drop("_g")


def running_min(df: DataFrame, order: str, value: str, groups=(), descending=False, out="running") -> DataFrame:
    """Inclusive running minimum of `value` over the distinct `order` values of each group, bucketed as above."""
    base, keys = _grouped(df.withColumn("_v", F.col(order).cast("double")), groups)
    cut = splitters(base, "_v", keys)
    rows = _same(base, cut.drop("_n"), keys).withColumn("_b", _locate(bucket_count(df))).drop("_sp")
    turn = F.desc if descending else F.asc
    earlier = W.partitionBy(*keys).orderBy(turn("_b")).rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "_b").agg(F.min(value).alias("_t")).withColumn("_o", F.min("_t").over(earlier)).drop("_t")
    within = W.partitionBy(*keys, "_b").orderBy(turn(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = _same(rows, before, [*keys, "_b"]).withColumn(out, F.least(F.min(value).over(within), F.col("_o"))).drop("_v", "_b", "_o")
    return joined if groups else joined.drop("_g")


def average_ranks(df: DataFrame, value: str, groups=(), out="rank", weight: str | None = None) -> DataFrame:
    """(group..., value, out) with the average rank of each distinct value; ties share their mean rank."""
    m = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(m.alias("m"))
    ranked = running_sums(stage(counts), value, ["m"], groups)  # read three times
    return ranked.select(*groups, value, (F.col("cum_m") - (F.col("m") - 1) / 2.0).alias(out))
