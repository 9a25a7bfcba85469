"""Bootstrap and permutation draws keyed by hash, never by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.functions.hashing import hash_key, poisson1, uniform
from varve.operators.ordering import hash_rank


def poisson_weights(df: DataFrame, ids, draws: int, seed=42, tag="boot") -> DataFrame:
    """Rows repeated per bootstrap `b` with a Poisson(1) weight `w` (rows drawn zero times are absent).

    The weights are independent per row, so every draw is one map-side combined aggregate with no join; one hash
    supplies four draws. Sums of weights differ from n by sampling noise, which vanishes as n grows. The draws multiply
    the work on a row, so rows are dealt evenly over the shuffle partitions before, while they are few.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ids)
    blocks = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 4))))
    hashed = blocks.withColumn("_h", hash_key(ids, seed, F.concat(F.lit(f"{tag}|"), F.col("_k").cast("string"))))
    four = F.array(*[F.struct((F.col("_k") * 4 + p).alias("b"), uniform(F.col("_h"), p).alias("u")) for p in range(4)])
    drawn = hashed.withColumn("_d", F.explode(four))
    drawn = drawn.withColumns({"b": F.col("_d.b"), "w": poisson1(F.col("_d.u"))}).drop("_k", "_h", "_d")
    return drawn.where((F.col("w") > 0) & (F.col("b") < draws))


def bootstrap_exact(df: DataFrame, ids, draws: int, seed=42) -> DataFrame:
    """(b, row, w): n draws with replacement from n rows per bootstrap, as multiplicities.

    Row i supplies the i-th draw: its hash modulo n names a rank. Costs draws x n rows through two shuffles; use
    `poisson_weights` when n is large.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    ranked = hash_rank(df, ids, seed=seed, tag="order", out="_rank")
    n = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    picks = df.select(*ids).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    h = hash_key(ids, seed, F.concat(F.lit("pick|"), F.col("b").cast("string")))
    picks = picks.select("b", (F.conv(F.substring(h, 1, 15), 16, 10).cast("long") % n + 1).alias("_rank"))
    times = picks.groupBy("b", "_rank").agg(F.count(F.lit(1)).alias("w"))
    return times.join(ranked, "_rank").drop("_rank")


def permute(df: DataFrame, ids, value: str, perms: int, seed=42, out="permuted", keep=()) -> DataFrame:
    """(perm, ids..., keep..., permuted): the value column shuffled over rows, once per permutation; the columns `keep` stay with their row.

    Donors are ranked once; receivers are ranked within each permutation by another hash; equal ranks meet. They meet by a merge: Spark
    estimates the receivers by the table before it is multiplied, and would broadcast all of them.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    donors = hash_rank(df.select(*ids, value), ids, seed=seed, tag="order", out="_rank").select("_rank", F.col(value).alias(out))
    tall = df.select(*ids, *keep).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))))
    receivers = hash_rank(tall, [*ids, "perm"], ["perm"], seed, "perm", "_rank")
    return receivers.hint("merge").join(donors, "_rank").drop("_rank")


def permutation_pvalue(null: DataFrame, stat: str, observed: float, groups=(), alternative="two-sided") -> DataFrame:
    """(1 + exceedances) / (1 + draws), on absolute values unless one-sided."""
    hit = F.abs(F.col(stat)) >= abs(observed) if alternative == "two-sided" else F.col(stat) >= observed
    out = null.groupBy(*groups).agg(F.count_if(hit).alias("n_exceed"), F.count(stat).alias("n_perm"))
    return out.withColumn("p", (1 + F.col("n_exceed")) / (1 + F.col("n_perm")))
