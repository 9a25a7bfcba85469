"""Splits, folds and class balancing, all by hash order of the row key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.hashing import hash_key, uniform
from varve.operators.ordering import hash_parts
from varve.session import stage, stage_small


def assign_split(df: DataFrame, ids, ratios=(0.8, 0.1, 0.1), strata=(), seed=42, exact=True, out="split") -> DataFrame:
    """train / val / test by ratio within each stratum; a null stratum is its own ("unknown").

    `exact` cuts each stratum at rounded row counts. Otherwise a hash threshold decides row by row: no pass over
    the data beforehand, sizes right only on average.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    total = float(sum(ratios))
    a, b = ratios[0] / total, (ratios[0] + ratios[1]) / total
    if exact:
        parts = hash_parts(df, ids, lambda n: [F.round(n * a), F.round(n * b)], strata, seed, "split", "_part")
        part = F.col("_part")
        named = F.when(part == 0, "train").when(part == 1, "val").otherwise("test")
    else:
        parts = df.withColumn("_part", uniform(hash_key(ids, seed, "split")))
        named = F.when(F.col("_part") < a, "train").when(F.col("_part") < b, "val").otherwise("test")
    return parts.withColumn(out, named).drop("_part")


def inner_split(df: DataFrame, ids, strata, val_ratio=0.25, seed=42, out="inner") -> DataFrame:
    """Stratified two-way split for threshold selection."""
    parts = hash_parts(df, ids, lambda n: [n - F.round(n * val_ratio)], strata, seed, "inner", "_part")
    return parts.withColumn(out, F.when(F.col("_part") == 0, "train").otherwise("val")).drop("_part")


def assign_folds(df: DataFrame, ids, k=5, strata=(), seed=42, tag="fold", out="fold") -> DataFrame:
    """Stratified k folds: each stratum is cut into k equal runs of its hash order."""
    def limits(n):
        return [F.floor(n * j / k) for j in range(1, k)]

    return hash_parts(df, ids, limits, strata, seed, tag, out)


def families(df: DataFrame, family: str, id_col: str, stratum: str) -> DataFrame:
    """One row per family: size and dominant stratum (ties to the smaller name).

    A subject without a family is a family of its own.
    """
    key = F.coalesce(F.col(family).cast("string"), F.concat(F.lit("solo:"), F.col(id_col).cast("string")))
    counts = df.groupBy(key.alias("family_key"), F.col(stratum).cast("string").alias("_st")).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy("family_key").agg(
        F.sum("_c").alias("size"), F.min_by("_st", F.struct(-F.col("_c"), F.col("_st"))).alias("stratum")
    )


def assign_group_folds(df: DataFrame, family: str, id_col: str, stratum: str, k=5, seed=42, out="fold") -> DataFrame:
    """Stratified folds of families, so siblings never part; joined back on the family."""
    key = F.coalesce(F.col(family).cast("string"), F.concat(F.lit("solo:"), F.col(id_col).cast("string")))
    folds = assign_folds(families(df, family, id_col, stratum), "family_key", k, ["stratum"], seed, "family", out)
    return df.withColumn("family_key", key).join(folds.select("family_key", out), "family_key").drop("family_key")


#: Families that one task deals, and families of each profile that are left for dealing one by one (times the number of folds).
DEALT, LEFT = 4096, 4


def deal(profiles: np.ndarray, k: int, totals: np.ndarray) -> np.ndarray:
    """A fold for each row of `profiles` (families x strata): the largest shares first, each to the fold that holds least of what it brings.

    The cost of a fold is the product of its counts with the family's, each over the square of the stratum's total: what the
    sum of squared class shares would grow by, less the part that is alike for all folds. Ties go to the smaller fold, then the first.
    """
    weight = 1.0 / np.maximum(totals, 1.0) ** 2
    held, out = np.zeros((k, profiles.shape[1])), np.empty(len(profiles), int)
    for i in np.lexsort((np.arange(len(profiles)), -((profiles**2) @ weight))):
        cost = np.round(held @ (weight * profiles[i]), 15)
        fold = min(range(k), key=lambda f: (cost[f], held[f].sum()))
        held[fold] += profiles[i]
        out[i] = fold
    return out


def balanced_group_folds(df: DataFrame, family: str, id_col: str, stratum: str, k=5, seed=42, out="fold") -> DataFrame:
    """Folds of whole families in which every stratum is spread evenly, also where families mix strata.

    Families of one profile (rows of each stratum) are alike: of each profile as many as come out even are dealt round by
    hash, and `LEFT * k` or a few more remain, which are dealt one by one. One task deals `DEALT` of those into k piles; piles are
    families again, until one task holds all that is left. A null family is a family of its own, a null stratum a stratum.
    The strata, not the families, must be few: their totals travel with the tasks. Columns of `df` stay; `out` is replaced.
    """
    key = F.coalesce(F.concat(F.lit("f:"), F.col(family).cast("string")), F.concat(F.lit("solo:"), F.col(id_col).cast("string")))
    cells = df.groupBy(key.alias("_key"), F.coalesce(F.col(stratum).cast("string"), F.lit("\0")).alias("_st")).agg(F.count(F.lit(1)).alias("_c"))
    cells = stage(cells)
    strata = cells.groupBy("_st").agg(F.sum("_c").alias("n")).orderBy("_st").toPandas()
    place = {name: i for i, name in enumerate(strata["_st"])}
    totals = strata["n"].to_numpy(dtype=float)
    profile = F.sort_array(F.collect_list(F.struct("_st", "_c")))
    fams = cells.groupBy("_key").agg(profile.alias("_profile")).withColumn("_name", F.md5(F.to_json("_profile")))
    counts = fams.groupBy("_name").agg(F.count(F.lit(1)).alias("_m"))
    even = F.greatest(F.lit(0), F.floor(F.col("_m") / k) - LEFT).cast("long") * k
    fams = stage(fams.join(counts.withColumn("_even", even), "_name"))
    ends = [F.floor(F.substring_index(F.col("_s"), "\u0001", -1).cast("long") * j / k) for j in range(1, k + 1)]
    part = hash_parts(fams, "_key", lambda n: ends, ["_name", "_even"], seed, "balanced family", "_part")
    part = stage(part.select("_key", "_profile", "_part"))
    folds = part.where(F.col("_part") < k).select("_key", F.col("_part").alias(out))

    def dealt(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_item")
        rows = np.zeros((len(pdf), len(totals)))
        for i, cells in enumerate(pdf["_profile"]):
            for cell in cells:
                rows[i, place[cell["_st"]]] = cell["_c"]
        piles = deal(rows, k, totals)
        return pd.DataFrame({"_item": pdf["_item"], "_pile": piles, "_block": pdf["_block"], "_profile": pdf["_profile"]})

    open_ = part.where(F.col("_part") == k).select(F.col("_key").alias("_item"), "_profile")
    kind = dict(open_.dtypes)["_profile"]
    ways, n = None, open_.count()
    while True:
        blocks = max(1, -(-n // max(DEALT, 4 * k)))
        block = (F.conv(F.substring(hash_key(["_item"], seed, "block"), 1, 8), 16, 10).cast("long") % blocks).cast("int")
        level = stage(open_.withColumn("_block", block).groupBy("_block").applyInPandas(dealt, f"_item string, _pile int, _block int, _profile {kind}"))
        pile = F.concat_ws(":", F.col("_block"), F.col("_pile"))
        step = level.select("_item", pile.alias("_to"), F.col("_pile").alias("_last"))
        ways = step.withColumnRenamed("_item", "_key") if ways is None else (
            ways.select("_key", F.col("_to").alias("_item")).join(step, "_item").select("_key", "_to", "_last")
        )
        ways = stage(ways)
        if blocks == 1:
            break
        spread = level.select(pile.alias("_item"), F.explode("_profile").alias("_cell")).groupBy("_item", "_cell._st").agg(F.sum("_cell._c").alias("_c"))
        open_ = stage(spread.groupBy("_item").agg(profile.alias("_profile")))
        n = open_.count()
    folds = folds.unionByName(ways.select("_key", F.col("_last").alias(out)))
    kept = [c for c in df.columns if c != out]
    return df.select(*kept, key.alias("_family_key")).join(folds.withColumnRenamed("_key", "_family_key"), "_family_key").select(*kept, out)


def class_spread(df: DataFrame, fold: str, stratum: str, k: int) -> DataFrame:
    """(stratum, n, least, most, spread): rows of each stratum in its emptiest and fullest fold, and their difference as a share of n."""
    each = [F.count_if(F.col(fold) == j) for j in range(k)]
    out = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.least(*each).alias("least"), F.greatest(*each).alias("most"))
    return out.withColumn("spread", (F.col("most") - F.col("least")) / F.col("n"))


def stratification_key(df: DataFrame, bin_col: str, site_col: str, k: int) -> tuple[Column, str]:
    """bin x site if every cell has at least k rows, else site, else bin; one pass over the cells."""
    cells = stage_small(df.groupBy(bin_col, site_col).agg(F.count(F.lit(1)).alias("n")))
    smallest = cells.agg(F.min("n")).first()[0] or 0
    if smallest >= k:
        return F.concat_ws("|", F.col(bin_col).cast("string"), F.col(site_col).cast("string")), "bin_site"
    by_site = cells.groupBy(site_col).agg(F.sum("n").alias("n")).agg(F.min("n")).first()[0] or 0
    if by_site >= k:
        return F.col(site_col).cast("string"), "site"
    return F.col(bin_col).cast("string"), "bin"


def fold_diagnostics(df: DataFrame, fold: str, target: str, site: str) -> DataFrame:
    """Per fold: train and test sizes, target mean and SD, sites on each side."""
    cells = df.groupBy(fold, site).agg(
        F.count(F.lit(1)).alias("n"), F.sum(target).alias("s"), F.sum(F.col(target) * F.col(target)).alias("ss")
    )
    cells = stage_small(cells)
    total = cells.agg(F.sum("n").alias("n"), F.countDistinct(site).alias("sites")).first()
    site_total = cells.groupBy(site).agg(F.sum("n").alias("all_n"))
    test = cells.groupBy(fold).agg(
        F.sum("n").alias("n_test"), F.countDistinct(site).alias("sites_test"), (F.sum("s") / F.sum("n")).alias("mean_test"),
        F.sqrt(F.sum("ss") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("sd_test"),
    )
    swallowed = cells.join(site_total, site).where(F.col("n") == F.col("all_n")).groupBy(fold).agg(F.count(F.lit(1)).alias("gone"))
    return test.join(swallowed, fold, "left").select(
        fold, (F.lit(total["n"]) - F.col("n_test")).alias("n_train"), "n_test", "mean_test", "sd_test",
        (F.lit(total["sites"]) - F.coalesce("gone", F.lit(0))).alias("sites_train"), "sites_test",
    )


def leaked_families(df: DataFrame, family: str, fold: str) -> DataFrame:
    """Families found in more than one fold (min/max combine map-side; no distinct)."""
    spread = df.where(F.col(family).isNotNull()).groupBy(family).agg(F.min(fold).alias("a"), F.max(fold).alias("b"))
    return spread.agg(F.count_if(F.col("a") != F.col("b")).alias("leaked"))


def compare_folds(df: DataFrame, fold_a: str, fold_b: str, k: int) -> DataFrame:
    """Per fold: overlap (Jaccard) and size difference of two assignments held as columns; one aggregate."""
    cells = stage_small(df.groupBy(fold_a, fold_b).agg(F.count(F.lit(1)).alias("n")))
    tall = cells.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    in_a, in_b = F.col(fold_a) == F.col("fold"), F.col(fold_b) == F.col("fold")
    sums = tall.groupBy("fold").agg(
        F.sum(F.when(in_a & in_b, F.col("n")).otherwise(0)).alias("both"),
        F.sum(F.when(in_a | in_b, F.col("n")).otherwise(0)).alias("either"),
        F.sum(F.when(in_a, F.col("n")).otherwise(0)).alias("size_a"),
        F.sum(F.when(in_b, F.col("n")).otherwise(0)).alias("size_b"),
    )
    jaccard = F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(F.lit(1.0))
    return sums.select("fold", jaccard.alias("jaccard"), F.abs(F.col("size_a") - F.col("size_b")).alias("size_diff"))


def balance_classes(df: DataFrame, ids, label: str, seed=42, iteration=0, groups=()) -> DataFrame:
    """Every class of each group cut to the size of its smallest class, in the hash order of the iteration."""
    groups = list(groups)
    sizes = df.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("_n"))
    least = (
        sizes.groupBy(*groups).agg(F.min("_n").alias("_least")) if groups else sizes.agg(F.min("_n").alias("_least"))
    )
    least = stage_small(least)
    tagged = df.join(least, groups) if groups else df.withColumn("_least", least.select("_least").scalar())
    strata = [*groups, label, "_least"]
    least_of = F.substring_index(F.col("_s"), "\u0001", -1).cast("long")
    kept = hash_parts(tagged, ids, lambda n: [least_of], strata, seed, f"balance|{iteration}", "_part")
    return kept.where("_part = 0").drop("_part", "_least")


def random_member(df: DataFrame, family: str, id_col: str, iteration: Column, seed=42) -> DataFrame:
    """One member per (iteration, family): the smallest hash, found by a map-side combined aggregate."""
    h = hash_key([id_col], seed, F.concat(F.lit("member|"), iteration.cast("string")))
    return df.groupBy(iteration.alias("iteration"), family).agg(F.min_by(id_col, F.struct(h, F.col(id_col))).alias(id_col))


def random_halves(df: DataFrame, family: str, iterations: int, seed=42) -> DataFrame:
    """(iteration, family, half): each iteration halves the families by hash rank."""
    fams = df.where(F.col(family).isNotNull()).select(family).distinct()
    tall = fams.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    halves = hash_parts(tall, [family, "iteration"], lambda n: [F.floor(n / 2)], ["iteration"], seed, "half", "_part")
    return halves.select("iteration", family, F.when(F.col("_part") == 0, "a").otherwise("b").alias("half"))


def random_draw(items: DataFrame, item: str, draws: int, m: int, seed=42) -> DataFrame:
    """(draw, item): m items per draw by hash rank."""
    tall = items.select(item).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    cut = hash_parts(tall, [item, "draw"], lambda n: [F.lit(m)], ["draw"], seed, "draw", "_part")
    return cut.where("_part = 0").select("draw", item)
