"""The subject-by-visit cohort table built from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# left/right feature pairs of the cohort table.
PAIRS = [("qty", "qty_lh", "qty_rh"), ("price", "price_lh", "price_rh"), ("disc", "disc_lh", "disc_rh")]
FEATURES = [c for _, l, r in PAIRS for c in (l, r)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order sums over the lines: one map-side combined aggregate. The discounts stay sums and counts, which add up over orders."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    old, new = F.when(status == "F", F.col("l_discount")), F.when(status == "O", F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum(F.when(flag == "A", F.col("l_quantity"))).alias("qty_lh"),
            F.sum(F.when(flag == "R", F.col("l_quantity"))).alias("qty_rh"),
            F.sum(F.when(flag == "A", F.col("l_extendedprice"))).alias("price_lh"),
            F.sum(F.when(flag == "R", F.col("l_extendedprice"))).alias("price_rh"),
            F.sum(old).alias("disc_l"), F.count(old).alias("n_l"), F.sum(new).alias("disc_r"), F.count(new).alias("n_r"),
        )
    )


def visit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of each customer and year in one row: mean total, most lines of an order, sums and means over the lines.

    Sums combine map-side, so a hot customer is no hot task. They are rounded, so the order of summation does not show."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("long").alias("yr"), "o_totalprice"
    )
    return (
        orders.join(line_features(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("id", "yr")
        .agg(
            F.round(F.avg("o_totalprice"), 6).alias("target"),
            F.max("lines").alias("qc"),
            *[F.round(F.sum(c), 2).alias(c) for c in ("qty_lh", "qty_rh", "price_lh", "price_rh")],
            F.round(F.try_divide(F.sum("disc_l"), F.sum("n_l")), 8).alias("disc_lh"),
            F.round(F.try_divide(F.sum("disc_r"), F.sum("n_r")), 8).alias("disc_rh"),
        )
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (id, yr): site, family, age, sex, target, qc and three left/right feature pairs."""
    who = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("site"), F.col("c_acctbal").alias("age")
    )
    sex = F.when(F.col("id") % 97 == 0, "3").when(F.col("id") % 2 == 0, "1").otherwise("2")
    return (
        visit_orders(spark, sf_dir)
        .join(who, "id")
        .select("id", "yr", "site", F.floor(F.col("id") / 2).alias("family"), "age", sex.alias("sex"), "target", "qc", *FEATURES)
    )


VISITS_SQL = """
line as (select l_orderkey, count(*) n_lines from lineitem group by 1),
vis as (select o_custkey id, year(o_orderdate) yr, round(avg(o_totalprice), 6) target, max(n_lines) qc from orders left join line on l_orderkey = o_orderkey group by 1, 2),
feat as (select o_custkey id, year(o_orderdate) yr,
   round(sum(case when l_returnflag='A' then l_quantity end), 2) qty_lh, round(sum(case when l_returnflag='R' then l_quantity end), 2) qty_rh,
   round(sum(case when l_returnflag='A' then l_extendedprice end), 2) price_lh, round(sum(case when l_returnflag='R' then l_extendedprice end), 2) price_rh,
   round(avg(case when l_linestatus='F' then l_discount end), 8) disc_lh, round(avg(case when l_linestatus='O' then l_discount end), 8) disc_rh
 from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
visits as (select v.id, v.yr, c.c_mktsegment site, cast(floor(v.id/2) as bigint) family, c.c_acctbal age,
  case when v.id%97=0 then '3' when v.id%2=0 then '1' else '2' end sex,
  v.target, v.qc, f.qty_lh,f.qty_rh,f.price_lh,f.price_rh,f.disc_lh,f.disc_rh
 from vis v join customer c on c.c_custkey=v.id left join feat f on f.id=v.id and f.yr=v.yr)
"""
