"""Poisson bootstraps of any number of draws without a row per draw.

The weights of a row in all draws come from hashes of its key, the same that `resample.poisson_weights` deals out as rows. A task makes
them as a matrix for a few hundred rows at a time and multiplies it with what each row adds to the statistics, so it emits one
row of sums a draw, whatever the number of its rows. Areas under the ROC curve need an order too: rows are cut into ranges
of the score once for all draws, and each range counts its concordant pairs for every draw.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.hashing import POISSON_CUTS
from varve.functions.md5 import md5_blocks

#: Cells of rows x draws in memory, and of draws x sums that a task accumulates.
CELLS, KEPT_CELLS = 2_000_000, 16_000_000
#: Tasks that rows of one very frequent score are dealt to.
SALTS = 64
#: A uniform draw is a 32-bit number over 2**32; at or above each of these its weight is one more.
_STEPS = [math.ceil(c * 2**32) for c in POISSON_CUTS if math.ceil(c * 2**32) < 2**32]


def _key(ids) -> Column:
    """What follows seed, tag and block in the hashed text; null ids add nothing, as in `hash_key`."""
    return F.concat(*[F.coalesce(F.concat(F.lit("|"), F.col(c).cast("string")), F.lit("")) for c in ids])


def _weigh(u: np.ndarray) -> np.ndarray:
    """Weights of 32-bit draws: how many steps each has reached. The higher steps are rare and looked for among those beyond the fourth only."""
    out = np.zeros(u.shape, np.uint8)
    for step in _STEPS[:4]:
        out += u >= step
    far = np.flatnonzero(u.ravel() >= _STEPS[3])
    high, flat = u.ravel()[far], out.ravel()
    for step in _STEPS[4:]:
        flat[far] += high >= step
    return flat.reshape(u.shape)


def weight_matrix(keys, draws: range, seed=42, tag="boot") -> np.ndarray:
    """(rows, draws) weights; `draws` begins and ends at multiples of four, as one hash makes four draws."""
    heads = [f"{seed}|{tag}|{k}".encode() for k in range(draws.start // 4, draws.stop // 4)]
    out = np.zeros((len(keys), len(heads), 4), np.uint8)
    for rows, some, u in md5_blocks(heads, [k.encode() for k in keys]):
        out[rows, some] = _weigh(u)
    return out.reshape(len(keys), len(draws))


def _fours(n: int) -> int:
    return -(-n // 4) * 4


def draw_sums(df: DataFrame, ids, stats: dict[str, Column], draws: int, seed=42, tag="boot") -> DataFrame:
    """(b, name...): for every draw the weighted sum of each statistic over all rows; draws in which no row is drawn are absent.

    A null statistic adds nothing. Rows are dealt evenly over the shuffle partitions, as all draws of a row are made in its task.
    """
    ids, names = [ids] if isinstance(ids, str) else list(ids), list(stats)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(_key(ids).alias("_key"), *[F.coalesce(e.cast("double"), F.lit(0.0)).alias(n) for n, e in stats.items()], F.lit(1.0).alias("_w")).repartition(parts, "_key")
    block = min(_fours(draws), _fours(max(4, KEPT_CELLS // (len(names) + 1))))
    blocks = -(-draws // block)
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0))

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            for k, pdf in batch.groupby("_block", sort=False):
                mine = range(k * block, min((k + 1) * block, _fours(draws)))
                step = max(1, CELLS // len(mine))
                for at in range(0, len(pdf), step):
                    part = pdf.iloc[at : at + step]
                    w = weight_matrix(part["_key"].tolist(), mine, seed, tag).astype(float)
                    sums[k] = sums.get(k, 0.0) + w.T @ part[[*names, "_w"]].to_numpy(float)
        for k, block_sums in sums.items():
            out = pd.DataFrame(block_sums, columns=[*names, "_w"])
            out.insert(0, "b", np.arange(k * block, k * block + len(out), dtype="int32"))
            yield out[out["b"] < draws]

    schema = ", ".join(["b int", *[f"`{n}` double" for n in [*names, "_w"]]])
    summed = rows.mapInPandas(partial, schema).groupBy("b").agg(*[F.sum(n).alias(n) for n in [*names, "_w"]])
    return summed.where("_w > 0").drop("_w")


def draw_auc(df: DataFrame, ids, y: str, score: str, draws: int, seed=42, tag="boot") -> DataFrame:
    """(b, auc): exact area with ties for every draw; null where a draw has one class only.

    Rows are cut into ranges of the score at approximate quantiles, which no tie crosses. A score so frequent that it is several
    quantiles is a range of its own, whose rows are dealt to several tasks: its pairs are half of positives times negatives.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    rows = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select(_key(ids).alias("_key"), F.col(score).cast("double").alias("_s"), (F.col(y) == 1).alias("_y"))
    cuts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = rows.agg(F.percentile_approx("_s", [i / cuts for i in range(1, cuts)], 100 * cuts).alias("p")).first()["p"] or []
    edges = sorted(set(points))
    hot = sorted({e for e in edges if points.count(e) > 1})
    below = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("_s"))) if edges else F.lit(0)
    is_hot = F.col("_s").isin(hot) if hot else F.lit(False)
    rows = rows.withColumns({"_hot": is_hot, "_unit": 2 * below + is_hot.cast("int")})
    rows = rows.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s", kind="stable")
        s, yes, keys = pdf["_s"].to_numpy(), pdf["_y"].to_numpy(dtype=float)[:, None], pdf["_key"].tolist()
        first = np.flatnonzero(np.diff(s, prepend=np.nan) != 0)
        step, out = max(4, CELLS // max(1, len(s)) // 4 * 4), []
        for at in range(0, _fours(draws), step):
            mine = range(at, min(at + step, _fours(draws)))
            w = np.concatenate([weight_matrix(keys[i : i + 20_000], mine, seed, tag) for i in range(0, len(keys), 20_000)]).astype(float)
            pos, neg = np.add.reduceat(w * yes, first, axis=0), np.add.reduceat(w * (1 - yes), first, axis=0)
            within = (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0)
            out.append(pd.DataFrame({"b": np.arange(mine.start, mine.stop, dtype="int32"), "pos": pos.sum(axis=0), "neg": neg.sum(axis=0), "within": within}))
        out = pd.concat(out)
        return out[out["b"] < draws].assign(_unit=pdf["_unit"].iloc[0], _hot=pdf["_hot"].iloc[0])[["_unit", "_hot", "b", "pos", "neg", "within"]]

    counted = rows.groupBy("_unit", "_salt").applyInPandas(count, "_unit int, _hot boolean, b int, pos double, neg double, within double")
    units = counted.groupBy("b", "_unit", "_hot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("within").alias("within"))
    units = units.withColumn("within", F.when(F.col("_hot"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("within")))
    before = Window.partitionBy("b").orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.sum(F.col("within") + F.col("pos") * F.coalesce(F.col("_below"), F.lit(0.0)))
    return units.withColumn("_below", F.sum("neg").over(before)).groupBy("b").agg(F.try_divide(pairs, F.sum("pos") * F.sum("neg")).alias("auc"))
