"""Permutations named by a keyed bijection: which row gives its value to which is computed, never sorted or shuffled.

Every row has a slot, its exact rank in hash order, given once. A Feistel network over the smallest power of four that holds the
group, repeated until the result is below the group's size, is a bijection of the slots for each permutation's key. A task works
out the donors of its rows for all permutations at once and reads their values from the shared vector.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.models.gram import Block, gram
from varve.operators.ordering import hash_rank
from varve.session import stage

ROUNDS = 6
#: Values in the vector that tasks share (8 bytes each); beyond, rows meet their donors in a join.
SHARED_VALUES = 4_000_000
#: Values that reach the driver as one row.
STRETCH = 1 << 16
#: Donors worked out at once: their temporary matrices stay small, however many rows a batch has.
DONORS = 250_000
# Fixed values of a round: a value plus its key, cut to 31 bits, times FACTOR, less its lowest SHIFT bits.
FACTOR, SHIFT, LOW31 = 1_103_515_245, 15, (1 << 31) - 1


def round_keys(perms: int, seed=42, tag="perm") -> np.ndarray:
    """(rounds, permutations): 31 bits of a hash of (seed, tag, permutation, round)."""
    digests = [[hashlib.md5(f"{seed}|{tag}|{j}|{r}".encode()).hexdigest() for j in range(perms)] for r in range(ROUNDS)]
    return np.array([[int(d[:8], 16) & LOW31 for d in row] for row in digests], np.int64).reshape(ROUNDS, perms)


def half_bits(n: int) -> int:
    """Bits of each half of the network for slots below n."""
    return max(1, -(-(n - 1).bit_length() // 2))


def _feistel(v: np.ndarray, keys, bits: int) -> np.ndarray:
    """The network over values below 4**bits; `keys` gives a row of keys a round. Of a product only bits below SHIFT + bits are used, which 32-bit numbers keep."""
    kind = v.dtype.type
    mask, low, factor, shift = kind((1 << bits) - 1), kind(LOW31), kind(FACTOR), kind(SHIFT)
    left, right, moved = v >> kind(bits), v & mask, np.empty_like(v)
    for key in keys:
        np.add(right, key, out=moved)
        moved &= low
        moved *= factor
        moved >>= shift
        moved &= mask
        left ^= moved
        left, right = right, left
    left <<= kind(bits)
    left |= right
    return left


def donors(slots: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """(rows, permutations): the slot below n whose value each row of `slots` gets. For each permutation a bijection of [0, n)."""
    bits, perms = half_bits(n), keys.shape[1]
    kind = np.uint32 if SHIFT + bits <= 32 and 2 * bits <= 32 else np.int64
    keys = keys.astype(kind)
    out = _feistel(np.repeat(np.asarray(slots).astype(kind), perms).reshape(len(slots), perms), keys, bits).ravel()
    at = np.flatnonzero(out >= n)
    values, perm = out[at], at % perms if len(at) else at
    while len(at):
        values = _feistel(values, (key[perm] for key in keys), bits)
        out[at] = values
        far = np.flatnonzero(values >= n)
        at, values, perm = at[far], values[far], perm[far]
    return out.reshape(len(slots), perms).astype(np.int64)


def number_rows(df: DataFrame, ids, groups=(), seed=42, tag="order") -> DataFrame:
    """`df` with `_slot` (from 0, in hash order of the group), and the group's `_size` and `_base` (rows of the groups before it).

    Values are shuffled within groups. Rows of one id share a hash; they are told apart by the other columns, so ids should be unique.
    """
    keyed = df.withColumn("_group", F.to_json(F.struct(*groups)) if groups else F.lit(""))
    sizes = keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    sizes = stage(sizes.withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0)).cast("long")))
    ranked = hash_rank(keyed, ids, ["_group"], seed, tag, "_slot").withColumn("_slot", F.col("_slot") - 1)
    return stage(ranked.join(sizes, "_group").drop("_group"))


def _vector(numbered: DataFrame, value: str, n: int) -> np.ndarray:
    """All values by place. Tasks put stretches of them together: a row of its own for each value would be many times the vector on the driver."""
    place = F.col("_base") + F.col("_slot")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["stretch"].iloc[0])
        out = np.full(min(STRETCH, n - at * STRETCH), np.nan)
        out[pdf["place"].to_numpy() - at * STRETCH] = pdf["v"].to_numpy(dtype=float)
        return pd.DataFrame({"stretch": [at], "v": [out.tobytes()]})

    values = numbered.select(F.floor(place / STRETCH).alias("stretch"), place.alias("place"), F.col(value).cast("double").alias("v"))
    vector = np.full(n, np.nan)
    for at, v in values.groupBy("stretch").applyInPandas(pack, "stretch long, v binary").toLocalIterator():
        vector[at * STRETCH : at * STRETCH + len(v) // 8] = np.frombuffer(v)
    return vector


def shuffled_targets(numbered: DataFrame, value: str, perms: int, seed=42, tag="perm") -> tuple[DataFrame, Block]:
    """The rows, and a block of targets `perm0`, `perm1`, ...: in each, the values of column `value` shuffled within the groups of `number_rows`.

    Up to `SHARED_VALUES` values are one broadcast vector, and nothing is shuffled for any number of permutations. Beyond, each row
    gets its donors' values by a join of rows x permutations and carries them as an array.
    """
    keys, names = round_keys(perms, seed, tag), [f"perm{j}" for j in range(perms)]
    n = numbered.count()
    if n <= SHARED_VALUES:
        shared = numbered.sparkSession.sparkContext.broadcast((_vector(numbered, value, n), keys))

        def make(rows: pd.DataFrame, which=slice(None)) -> np.ndarray:
            values, some = shared.value
            some = some[:, which]
            out = np.empty((len(rows), some.shape[1]))
            bases, sizes, own = rows["_base"].to_numpy(), rows["_size"].to_numpy(), rows["_slot"].to_numpy()
            for base in np.unique(bases):
                mine = np.flatnonzero(bases == base)
                step = max(1, DONORS // max(1, some.shape[1]))
                for at in range(0, len(mine), step):
                    here = mine[at : at + step]
                    out[here] = values[base + donors(own[here], int(sizes[here[0]]), some)]
            return out

        return numbered, Block(names, ["_slot", "_size", "_base"], make)
    shared_keys = numbered.sparkSession.sparkContext.broadcast(keys)

    def pairs(batches):
        some = shared_keys.value
        for batch in batches:
            for at in range(0, len(batch), max(1, 1_000_000 // perms)):
                pdf = batch.iloc[at : at + max(1, 1_000_000 // perms)]
                for (base, size), mine in pdf.groupby(["_base", "_size"]):
                    own = mine["_slot"].to_numpy()
                    got = donors(own, int(size), some)
                    yield pd.DataFrame({"_to": np.repeat(base + own, perms), "_perm": np.tile(np.arange(perms, dtype="int32"), len(own)), "_from": (base + got).ravel()})

    place = (F.col("_base") + F.col("_slot")).alias("_to")
    wanted = numbered.select("_slot", "_size", "_base").mapInPandas(pairs, "_to long, _perm int, _from long")
    given = numbered.select(place.alias("_from"), F.col(value).cast("double").alias("_v"))
    met = wanted.join(given, "_from").groupBy("_to").agg(F.sort_array(F.collect_list(F.struct("_perm", "_v"))).alias("_all"))
    held = numbered.withColumn("_to", place).join(met.select("_to", F.col("_all._v").alias("_values")), "_to").drop("_to")
    return stage(held), Block(names, ["_values"], lambda rows, which=slice(None): np.stack(rows["_values"].to_numpy()).astype(float)[:, which])


def shuffled_correlations(df: DataFrame, ids, features, target: str, perms: int, groups=(), seed=42) -> DataFrame:
    """(groups..., feature, perm, r): Pearson r of each feature with each shuffle of the target, from one pass of cross products.

    Rows with a null feature or target are left out before. Null where a side is constant.
    """
    features, groups, ids = list(features), list(groups), [ids] if isinstance(ids, str) else list(ids)
    rows = df.select(*ids, *groups, *[F.col(c).cast("double").alias(c) for c in [*features, target]]).dropna("any", subset=[*features, target])
    # Products of shifted values keep their digits; r does not change.
    mean = rows.agg(*[F.avg(c).alias(c) for c in [*features, target]]).first()
    rows = stage(rows.select(*ids, *groups, *[(F.col(c) - F.lit(mean[c] or 0.0)).alias(c) for c in [*features, target]]))
    numbered, block = shuffled_targets(number_rows(rows, ids, groups, seed), target, perms, seed)
    table = gram(numbered, features, [], groups, block=block)
    head, kinds = 1 + len(features), dict(table.dtypes)
    names = [*groups, "feature", "perm", "r"]
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in groups], "feature string, perm int, r double"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        from varve.models.gram import Moments

        m = Moments.read(pdf, head, head + perms)
        n = m.xx[0, 0]
        vx, vy = np.diag(m.xx)[1:] - m.xx[0, 1:] ** 2 / n, m.yy - m.xy[0] ** 2 / n
        cov = m.xy[1:] - np.outer(m.xx[0, 1:], m.xy[0]) / n
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where((vx[:, None] > 0) & (vy > 0), cov / np.sqrt(np.outer(vx, vy)), np.nan)
        out = pd.DataFrame({"feature": np.repeat(features, perms), "perm": np.tile(np.arange(perms, dtype="int32"), len(features)), "r": r.ravel()})
        for g in groups:
            out[g] = pdf[g].iloc[0]
        return out[names]

    out = table.withColumn("_one", F.lit(0)).groupBy(*(groups or ["_one"])).applyInPandas(solve, schema)
    return out.withColumn("r", F.nanvl("r", F.lit(None).cast("double")))
