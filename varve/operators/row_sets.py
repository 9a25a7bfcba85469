"""Many random sets of a table's rows as matrices made within the tasks, for `gram.member_gram`; they are those of `splits.random_halves` and `random_member`."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.functions.md5 import md5_halves

#: Families that a task hashes at once; standard errors within which the middle hash is looked for first.
AT_ONCE, REACH = 5_000, 6.0
_SIGN = np.uint64(1 << 63)


def _half_hashes(families, iterations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (iterations x families); families of one length should follow each other."""
    return md5_halves([f"{seed}|half|{f}".encode() for f in families], [f"|{j}".encode() for j in range(iterations)])


def _signed(v: np.ndarray) -> np.ndarray:
    return (v ^ _SIGN).view(np.int64)


def middle_hashes(df: DataFrame, family: str, iterations: int, seed=42) -> tuple[np.ndarray, np.ndarray] | None:
    """Both halves of the hash that ends each iteration's first half of the families; None if that half is empty.

    Hashes are uniform, so the middle one lies near the middle: only those near it are ordered, the ones below are counted. If an iteration's is
    not among them the search is widened.
    """
    fams = df.where(F.col(family).isNotNull()).select(F.col(family).cast("string").alias("f")).distinct()
    n = fams.count()
    k = n // 2
    if not k:
        return None
    reach = REACH * 0.5 / n**0.5
    while True:
        low, high = (int(min(max(k / n + s * reach, 0.0), 1.0) * (2**64 - 1)) for s in (-1, 1))

        def near(batches, low=np.uint64(low), high=np.uint64(high)):
            for batch in batches:
                for at in range(0, len(batch), AT_ONCE):
                    names = sorted(batch["f"].iloc[at : at + AT_ONCE], key=len)
                    first, second = _half_hashes(names, iterations, seed)
                    yield pd.DataFrame({"it": np.arange(iterations), "below": (first < low).sum(axis=1), "near": False, "h": 0, "l": 0})
                    it, place = np.nonzero((first >= low) & (first <= high))
                    yield pd.DataFrame({"it": it, "below": 0, "near": True, "h": _signed(first[it, place]), "l": _signed(second[it, place])})

        def middle(pdf: pd.DataFrame) -> pd.DataFrame:
            rank = k - int(pdf["below"].sum()) - 1
            some = pdf[pdf["near"]].sort_values(["h", "l"])
            found = some.iloc[rank : rank + 1] if rank >= 0 else some.iloc[:0]
            return found.assign(it=int(pdf["it"].iloc[0]))[["it", "h", "l"]]

        counted = fams.mapInPandas(near, "it int, below long, near boolean, h long, l long")
        # Several times the square root of the families per iteration.
        ends = counted.groupBy("it").applyInPandas(middle, "it int, h long, l long").toPandas().sort_values("it")
        if len(ends) == iterations:
            return tuple(ends[c].to_numpy(np.int64).view(np.uint64) ^ _SIGN for c in ("h", "l"))
        reach *= 8


def halves_of(df: DataFrame, family: str, iterations: int, seed=42) -> tuple[DataFrame, Callable, list[str]]:
    """Rows with a family, how a task deals them into the first halves (sets 0 to iterations - 1) and the second, and the columns that takes."""
    ends = middle_hashes(df, family, iterations, seed)
    shared = df.sparkSession.sparkContext.broadcast(ends)

    def deal(batches):
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                rows = batch.iloc[at : at + AT_ONCE].reset_index(drop=True)
                codes, names = pd.factorize(rows["_family"])
                order = np.argsort([len(x) for x in names], kind="stable")
                place = np.empty(len(order), int)
                place[order] = np.arange(len(order))
                first = np.zeros((len(rows), iterations))
                if shared.value is not None:
                    high, low = shared.value
                    h, l = _half_hashes([names[i] for i in order], iterations, seed)
                    early = (h < high[:, None]) | ((h == high[:, None]) & (l <= low[:, None]))
                    first = early.T[place[codes]].astype(float)
                yield rows, np.hstack([first, 1.0 - first])

    return df.where(F.col(family).isNotNull()).withColumn("_family", F.col(family).cast("string")), deal, ["_family"]


def members_of(df: DataFrame, family: str, id_col: str, iterations: int, seed=42) -> tuple[DataFrame, Callable, list[str]]:
    """Rows with families together, how a task deals one member of each family into every set, and the columns that takes.

    A task holds one batch and, of a family that goes on, the rows that are still a set's member. Rows of a very large family meet within
    their batches before, where all but these leave.
    """
    heads = [f"{seed}|member|{j}".encode() for j in range(iterations)]

    def chosen(rows: pd.DataFrame) -> np.ndarray:
        """(rows, sets): whether a row has the least hash of its family; equal families follow each other."""
        high, low = md5_halves(heads, [i.encode() for i in rows["_id"]])
        starts = np.flatnonzero(rows["_family"].to_numpy() != rows["_family"].shift().to_numpy())
        sizes = np.diff(np.append(starts, len(rows)))
        out = high == np.repeat(np.minimum.reduceat(high, starts, axis=0), sizes, axis=0)
        low = np.where(out, low, ~np.uint64(0))
        return out & (low == np.repeat(np.minimum.reduceat(low, starts, axis=0), sizes, axis=0))

    def thin(batches):
        for batch in batches:
            large = batch["_family"].map(batch["_family"].value_counts()) > iterations
            if large.any():
                some = batch[large].sort_values("_family", kind="stable")
                batch = pd.concat([batch[~large], some[chosen(some).any(axis=1)]])
            yield batch

    def deal(batches):
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if kept is None else pd.concat([kept, batch])
            goes_on = (rows["_family"] == rows["_family"].iloc[-1]).to_numpy()
            kept, rows = rows[goes_on], rows[~goes_on].reset_index(drop=True)
            if len(kept) > iterations:
                kept = kept[chosen(kept).any(axis=1)]
            if len(rows):
                yield rows, chosen(rows).astype(float)
        if kept is not None:
            yield kept.reset_index(drop=True), chosen(kept).astype(float)

    name = F.coalesce(F.concat(F.lit("f"), F.col(family).cast("string")), F.lit(""))
    own = F.coalesce(F.concat(F.lit("|"), F.col(id_col).cast("string")), F.lit(""))
    rows = df.withColumns({"_family": name, "_id": own})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.mapInPandas(thin, rows.schema).repartition(parts, "_family").sortWithinPartitions("_family")
    return rows, deal, ["_family", "_id"]
