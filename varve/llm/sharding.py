"""Sharding by a minimax contiguous partition of ordered groups.

Equal texts are one group; groups are ordered by a digest of their text. The smallest capacity for which a greedy cut needs no
more shards than wanted is found by binary search over prefix sums. The driver holds the sums of digest ranges, each large
group as a sum of its own, and single groups only of the ranges that hold a cut for a capacity still in question; all
grow with the square root of the number of groups.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.hashing import hash_key
from varve.llm.tables import unused
from varve.session import stage

SLOT_ROWS = 4096


def greedy_cuts(prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends (indexes into `prefix`, which starts with 0) of the fullest contiguous shards of at most `capacity`; None if they do not reach the end."""
    at, cuts = 0, []
    for _ in range(shards):
        at = bisect.bisect_right(prefix, prefix[at] + capacity) - 1
        cuts.append(at)
    return cuts if prefix[at] == prefix[-1] else None


def smallest_capacity(prefix: list[int], shards: int, low: int) -> int:
    """Least capacity, at least `low`, for which the greedy cut reaches the end."""
    high = max(low, prefix[-1])
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(prefix, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def furthest_cuts(prefix: list[int], whole: list[bool], capacity: int, shards: int) -> list[int]:
    """Upper bounds (sums, not indexes) on the ends of the fullest shards, as an entry that is not `whole` may be cut at any place."""
    at, ends = 0, []
    for _ in range(shards):
        at = min(at + capacity, prefix[-1])
        i = bisect.bisect_right(prefix, at) - 1
        if i < len(whole) and whole[i]:
            at = prefix[i]
        ends.append(at)
    return ends


def open_entries(prefix: list[int], whole: list[bool], capacity: int, shards: int, limit: int) -> list[int]:
    """Entries that must be split to know the cuts for `capacity`, those of the first cuts first; none if the cuts are known.

    A later cut's bounds are as wide as all entries cut before it, so the list ends after `limit` entries: once the
    first are split, few are left of the others."""
    at, found = 0, {}
    for end in furthest_cuts(prefix, whole, capacity, shards):
        at = bisect.bisect_right(prefix, prefix[at] + capacity) - 1
        for i in range(at, min(bisect.bisect_right(prefix, end), len(whole))):
            if not whole[i] and end > prefix[i]:
                found[i] = None
            if len(found) >= limit:
                return list(found)
    return list(found)


def partition_cuts(groups: DataFrame, shards: int) -> list[str]:
    """The last digest of each shard but the last one, for `groups(digest, bytes)`, one row per digest; fewer if fewer shards are needed."""
    about = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"), F.max("bytes").alias("most")).first()
    if not about["n"]:
        return []
    spark = groups.sparkSession
    digits = max(2, math.ceil(math.log(9 * shards * about["n"], 16) / 2))
    # A group as large as a mean range is an entry of its own: there are no more of them than ranges, and no cut is then wide.
    ranged = groups.select("digest", "bytes", F.substring("digest", 1, digits).alias("range"))
    alone: dict[str, list[str]] = {}
    for r in ranged.where(F.col("bytes") >= about["total"] / 16**digits).select("range", "digest").collect():
        alone.setdefault(r["range"], []).append(r["digest"])
    big = spark.createDataFrame([(r, sorted(d)) for r, d in alone.items()], "range string, big array<string>")
    # Pieces of a range: 0 before its first large group, 1 that group, 2 from there to the second, and so on.
    before = F.size(F.filter("big", lambda d: d < F.col("digest")))
    piece = F.when(F.col("big").isNull(), 0).otherwise(2 * before + F.array_contains("big", F.col("digest")).cast("int"))
    pieces = ranged.join(big, "range", "left").select("range", piece.alias("piece"), "digest", "bytes")
    sums = pieces.groupBy("range", "piece").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("digest").alias("last"))
    entries = sorted((r["range"], r["piece"], r["last"], r["bytes"], r["n"]) for r in sums.collect())
    low = max(-(-about["total"] // shards), about["most"])
    while True:
        prefix, whole = [0], [n == 1 for *_, n in entries]
        for *_, size, _ in entries:
            prefix.append(prefix[-1] + size)
        high = top = smallest_capacity(prefix, shards, low)  # cuts between entries only: no better than cuts between groups
        while low < high:
            mid = (low + high) // 2
            if furthest_cuts(prefix, whole, mid, shards)[-1] < prefix[-1]:
                low = mid + 1
            else:
                high = mid
        split = {i for c in {low, (low + top) // 2} for i in open_entries(prefix, whole, c, shards, 64 + 2 * shards)}
        if low == top and not split:
            return [entries[c - 1][2] for c in greedy_cuts(prefix, low, shards)[:-1] if prefix[c] < prefix[-1]]
        chosen = spark.createDataFrame([entries[i][:2] for i in split], "range string, piece int")
        single = pieces.join(chosen, ["range", "piece"], "left_semi").select("range", "piece", "digest", "bytes").collect()
        entries = sorted([e for i, e in enumerate(entries) if i not in split] + [(*r, 1) for r in single])


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """`docs` with `size` (UTF-8 bytes plus 1), `text_digest`, `shard` (from 0) and `slot` (gapless from 0 in each shard, a seeded shuffle).

    Equal texts, null being a text of its own, stay together, so a shard can only be as small as the largest group of
    equal texts. Columns of `docs` with these names are replaced, others stay whatever they are called. Rows equal in doc_id and text get neighbouring slots in
    any order. An empty table has no shards.
    """
    if "text" not in docs.columns:
        docs = docs.withColumn("text", F.lit(None).cast("string"))
    if "doc_id" not in docs.columns:
        docs = docs.withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.select(*[c for c in docs.columns if c not in ("size", "text_digest", "shard", "slot")])
    digest = F.coalesce(F.md5("text"), F.lit("null".ljust(32, "-")))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    groups = stage(docs.select(digest.alias("digest"), size.alias("size")).groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    cuts = partition_cuts(groups, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(F.col("text_digest") > cut, 1).otherwise(0)
    placed = docs.withColumn("text_digest", digest).withColumn("size", size).withColumn("shard", shard)

    # Slots: what the digest ranges before hold, and the place in the own range. Ranges are of the row, so copies spread.
    rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    digits = 1
    while rows > SLOT_ROWS * 16**digits:
        digits += 1
    order, part, place, ahead = unused(docs, "_order", "_range", "_place", "_before")
    placed = placed.withColumn(order, hash_key(["doc_id", "text_digest"], seed, "slot")).withColumn(part, F.substring(order, 1, digits))
    counts = placed.groupBy("shard", part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(ahead))
    own = Window.partitionBy("shard", part).orderBy(order, "doc_id")
    placed = placed.withColumn(place, F.row_number().over(own)).join(counts, ["shard", part])
    return placed.select(*docs.columns, "size", "text_digest", "shard", (F.col(ahead) + F.col(place) - 1).cast("long").alias("slot"))
