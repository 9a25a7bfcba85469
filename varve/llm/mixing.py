"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

The words of a source, its documents in a seeded order, are cut into equal blocks. Targets turn into block quotas by the
highest quotients; whole multiples of a source's blocks are whole passes over it, and the rest of its quota is a run of
consecutive blocks from a seeded start. As the order is seeded, the run is a sample, and it cuts two documents at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.hashing import hash_key
from varve.llm.tables import columns_or_null, unused, word_count
from varve.session import stage, stage_small

BUCKET_ROWS = 4096


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """`sources(source, source_size)` with `position` (by code point, null last), `weight` and `target`.

    The targets share the sum of all sizes by weight. One stops at `most` times its source's size; the excess is shared
    among the others by weight until none is above. One row per source, so the windows here are over few rows."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    out = sources.withColumn("position", F.row_number().over(order))
    out = out.withColumn("weight", F.element_at(cycle, F.pmod(F.col("position") - 1, F.lit(len(weights))).cast("int") + 1))
    out = out.withColumn("cap", (F.col("source_size") * most).cast("double"))
    every = Window.partitionBy()
    # Those that reach their cap first, by size for their weight, are full while the share of the rest would exceed theirs.
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "position").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every)
    before = lambda c: F.coalesce(F.sum(c).over(by_cap), F.lit(0.0))
    out = out.withColumn("full", F.col("cap") * (F.sum("weight").over(every) - before("weight")) <= F.col("weight") * (total - before("cap")))
    left = total - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    return out.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * left / open_weight)).drop("full")


def block_quotas(targets: DataFrame, block_words: int = 32, most: int = 3, seed: int = 42) -> DataFrame:
    """Adds `blocks` (equal blocks of the source), `quota` (blocks to take, repeats counted), `passes`, and the seeded run
    of the rest as up to two word ranges [from_1, to_1) and [from_2, to_2).

    Seats go to the highest quotients v / (2 j + 1), v being the target in blocks of the source. With m sources every quota
    lies within m / 2 shares of proportional, so only the seats in that range are ranked, a few for each source."""
    every = Window.partitionBy()
    size = F.col("source_size")
    out = targets.withColumn("blocks", F.when(size > 0, F.greatest(F.lit(1), F.floor(size / block_words + 0.5))).otherwise(0).cast("long"))
    out = out.withColumn("v", F.when(size > 0, F.col("target") * F.col("blocks") / size).otherwise(0.0))
    out = out.withColumn("seats", F.floor(F.sum("v").over(every) + 0.5)).withColumn("half", F.count(F.lit(1)).over(every) / 2.0)
    share = lambda n: F.when(F.sum("v").over(every) > 0, F.col("v") * n / F.sum("v").over(every)).otherwise(0.0)
    out = out.withColumn("sure", F.greatest(F.lit(0), F.floor(share(F.col("seats") - F.col("half")) - 1.5)).cast("long"))
    out = out.withColumn("last", F.least(F.col("blocks") * most, F.ceil(share(F.col("seats") + F.col("half")) + 1.5)).cast("long"))
    out = out.withColumn("free", F.col("seats") - F.sum("sure").over(every))
    offers = out.where("last > sure").select("position", "free", "v", F.explode(F.sequence("sure", F.col("last") - 1)).alias("seat"))
    ranked = offers.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.col("v") / (2 * F.col("seat") + 1)), "position", "seat")))
    won = ranked.where("rank <= free").groupBy("position").agg(F.count(F.lit(1)).alias("won"))
    out = out.join(won, "position", "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0)))
    out = out.withColumn("passes", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long"))
    draw = F.conv(F.substring(hash_key(["source"], seed, "run"), 1, 8), 16, 10).cast("long")
    start = F.pmod(draw, F.col("blocks"))
    stop = start + F.pmod(F.col("quota"), F.col("blocks"))

    def word_at(block: Column) -> Column:  # exact beyond 64 bits
        return F.floor(block.cast("decimal(19,0)") * size.cast("decimal(18,0)") / F.col("blocks").cast("decimal(18,0)")).cast("long")

    some = F.col("blocks") > 0
    zero = F.lit(0).cast("long")
    return out.select(
        "source", "source_size", "position", "target", "blocks", "quota", "passes",
        F.when(some, word_at(start)).otherwise(zero).alias("from_1"),
        F.when(some, word_at(F.least(stop, F.col("blocks")))).otherwise(zero).alias("to_1"),
        zero.alias("from_2"),
        F.when(some & (stop > F.col("blocks")), word_at(stop - F.col("blocks"))).otherwise(zero).alias("to_2"),
    )


def shard_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """(source, shard, blocks): each source's quota dealt out over `shards`, sources and shards both even to within one block."""
    first = F.coalesce(F.sum("quota").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = quotas.withColumn("first", first).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    upto = lambda n: F.floor((n - F.col("shard") + shards - 1) / shards)
    return dealt.select("source", "shard", (upto(F.col("first") + F.col("quota")) - upto(F.col("first"))).cast("long").alias("blocks"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 32, seed: int = 42) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken), one row per row of `docs(doc_id, text, source)`.

    `size` counts the words of the text (null: 0); `taken` says how many words the mix takes of the row, repeats counted,
    at most `most * size`. A null source is a source. Empty texts and sources without words take nothing. Rows that are
    equal in all three columns may differ in `taken`; which of them does not matter. Draws depend on doc_id and seed alone.
    """
    docs = columns_or_null(docs, doc_id="long", text="string", source="string")
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash_key(["doc_id"], seed, "mix").alias("key")))
    sums = stage_small(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    quotas = stage_small(block_quotas(source_targets(sums.select("source", "source_size"), weights, most), block_words, most, seed))

    rows = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    digits = 1
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    placed = sized.join(quotas, sized.source.eqNullSafe(quotas.source)).drop(quotas.source).withColumn("bucket", F.substring("key", 1, digits))
    # Where a document's words begin in its source: what the buckets before hold, and the documents before it in its own.
    per_bucket = placed.groupBy("position", "bucket").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("position").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select("position", "bucket", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("position", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0))).join(per_bucket, ["position", "bucket"])
    begin = F.col("ahead") + F.col("inside")
    end = begin + F.col("size")
    overlap = lambda k: F.greatest(F.lit(0), F.least(end, F.col(f"to_{k}")) - F.greatest(begin, F.col(f"from_{k}")))
    return placed.select("doc_id", "size", "source", "source_size", "target", (F.col("passes") * F.col("size") + overlap(1) + overlap(2)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as often as the mix takes them: `taken / size`, rounded to whole documents. Columns stay as they are, whatever they are called.

    Rows that share a doc_id, size and source are counted together: each gets their mean. Of doc_id, text and source, a column that
    the table lacks counts as null, so without texts nothing is taken."""
    taken = mix_sources(docs, **options).groupBy("doc_id", "size", "source").agg((F.sum("taken") / F.count(F.lit(1))).alias("taken"))
    words, doc, source, copies, copy = unused(docs, "_words", "_doc", "_source", "_copies", "_copy")
    wanted = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = taken.where("size > 0").select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("source").alias("_from"), wanted.alias("_wanted")).where("_wanted > 0")
    taken = taken.toDF(*(f"{c}{copies}" for c in taken.columns))  # apart from all columns of `docs`
    have = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind)
    sized = docs.withColumns({words: word_count(have("text", "string")), doc: have("doc_id", "long"), source: have("source", "string")})
    id_, size, from_, times = (taken[c] for c in taken.columns)
    same = sized[doc].eqNullSafe(id_) & (sized[words] == size) & sized[source].eqNullSafe(from_)
    out = sized.join(taken, same).withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
    return out.select(*[sized[c] for c in docs.columns])
