"""Near-duplicate groups by b-bit MinHash.

Every document becomes the set of its distinct word shingles. Equal sets are one class from the start, so
thousands of copies cost one row. Classes that agree on all minima of a band are candidates; the low bits of
all minima, packed into eight longs, give a collision-corrected estimate of the similarity that drops hopeless
candidates; the rest is confirmed on the full sets. Links make components.

A bucket is never expanded into all its pairs. Its members are first held against one hub, the member whose own
buckets are the largest, which is near the centre of a group of copies. What the links then leave in different
components is compared in blocks, by products of incidence matrices over full sets; a block returns no more links
than it takes to join its components.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.components import connected_components
from varve.llm.tables import columns_or_null, may_hold
from varve.llm.words import WHITE_SPACE, chain, mix, slices, split_words
from varve.session import stage

#: Bands of six minima: two documents at a similarity of 0.8 share none of the 32 once in 16,000 times, at 0.85 once in 3.7 million.
LANES, BITS, ROWS = 192, 4, 6
BANDS = LANES // ROWS
#: Members of a block, and shingles of one step of its product.
BLOCK, WIDE = 1024, 4096
#: Standard deviations of the estimate that a true link may fall short before it is dropped unconfirmed.
MARGIN = 6.0

_draw = np.random.default_rng(7)
_FACTOR = (_draw.integers(0, 2**32, LANES, dtype=np.uint32) | np.uint32(1))[:, None]
_SHIFT = _draw.integers(0, 2**32, LANES, dtype=np.uint32)[:, None]


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Per text its distinct shingles as sorted 64-bit hashes: `width` words each, or all words of a shorter text."""
    words = split_words(column, WHITE_SPACE, fold=True)
    h, n = words.hash, len(words.hash)
    runs = chain(h[i : n - width + 1 + i] for i in range(width)) if n >= width else h[:0]
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            whole = h[a : a + 1]
            for i in range(a + 1, b):
                whole = chain((whole, h[i : i + 1]))
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def _minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(LANES, 2**32 - 1, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(low, (x[None, at : at + 4096] * _FACTOR + _SHIFT).min(axis=1), out=low)
    return low


def _digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def _signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), width)
            low = np.stack([_minima(s) for s in sets])
            bands = chain(low.reshape(-1, BANDS, ROWS)[:, :, i].astype(np.uint64) for i in range(ROWS)) + np.arange(BANDS, dtype=np.uint64)
            low ^= low >> np.uint32(15)
            lanes = (low & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(len(sets), -1, 64 // BITS)
            packed = (lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
            as_lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), as_lists(packed), as_lists(mix(bands))],
                names=["doc_id", "n_shingles", "digest", "signature", "bands"],
            )

    return sign


def _set_maker(width: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), width)
            values = pa.array(np.concatenate(sets).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["digest", "shingles"])

    return make


def estimated_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity from two packed signatures: lanes that agree, less those that agree by chance."""

    def differing(x: Column) -> Column:  # a lane's low bit is set if any of its bits is
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        folded = folded.bitwiseOR(F.shiftrightunsigned(folded, 2))
        return F.bit_count(folded.bitwiseAND(F.lit(0x1111111111111111)))

    counts = F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y)))
    agree = 1 - F.aggregate(counts, F.lit(0), lambda s, x: s + x) / F.lit(float(LANES))
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def near_duplicate_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, class_size, component_id, kept) of `docs(doc_id, text)`, one per input row.

    Documents are linked when `100 * |A and B| >= percent * |A or B|` over their distinct shingles of `width`
    lower-cased (A-Z) words; a shorter text is one shingle of all its words. `component_id` is the smallest
    doc_id that links lead to, the row's own included; `kept` marks the rows with that id.

    Null or wordless texts have the empty set, are linked with nothing and kept. Repeated rows share a class: all
    rows with the smallest id are kept. A null doc_id takes part in links but is an id only where its component
    has no other. Texts of any length are taken whole. Missing columns read as null, extra ones are ignored.
    """
    docs = columns_or_null(docs, doc_id="long", text="string")
    signed = stage(docs.mapInArrow(_signer(width), "doc_id long, n_shingles long, digest binary, signature array<long>, bands array<long>"))
    classes = (
        signed.where("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("class_size"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    )
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()))  # staged, so a class keeps its number

    links = _links(docs, classes, width, percent)
    labels = connected_components(links)
    of_class = classes.select("node", "digest", "id", "class_size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = of_class.groupBy("label").agg(F.min("id").alias("component_id"))
    of_class = of_class.join(smallest, "label").select("digest", "class_size", "component_id")
    placed = signed.where("n_shingles > 0").select("doc_id", "n_shingles", "digest").join(of_class, "digest")
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(1).cast("long").alias("class_size"), F.col("doc_id").alias("component_id"))
    out = placed.select("doc_id", "n_shingles", "class_size", "component_id").union(empty)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes; enough of them to give the components of all links."""
    banded = classes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(banded.join(crowded, "bucket"))
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    members = stage(members.join(weights, "node"))

    hubs = members.groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
    pairs = members.join(hubs, "bucket").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    sets = _sets(docs, classes, members, width)
    links = stage(_confirmed(_likely(pairs, classes, percent), sets, percent))

    # What the hub did not settle: buckets of three or more that still hold different components.
    labels = connected_components(links)
    held = members.select("node", "bucket", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = held.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    held = held.where("size > 2").join(open_, "bucket")
    blocks = F.ceil(F.col("size") / BLOCK)
    held = held.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    held = held.select("bucket", "node", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sets, "node")
    rest = held.groupBy("bucket", "i", "j").applyInArrow(_block_linker(percent), "a long, b long")
    return links.union(stage(rest))


def _block_linker(percent: int):
    def link(table: pa.Table) -> pa.Table:
        """Links of one block that join two of its components: a spanning forest of all its links."""
        table = table.combine_chunks()
        nodes, label = table["node"].to_numpy(), table["label"].to_numpy().copy()
        lists = table["shingles"].chunk(0) if table["shingles"].num_chunks else pa.array([], pa.list_(pa.int64()))
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        row = np.repeat(np.arange(len(nodes)), size)
        _, column, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        row, column = row[shared], column[shared]
        column = np.unique(column, return_inverse=True)[1]
        common = np.zeros((len(nodes), len(nodes)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, WIDE):
            part = slice(*np.searchsorted(column, (at, at + WIDE)))
            has = np.zeros((len(nodes), WIDE), np.float32)
            has[row[part], column[part] - at] = 1
            common += has @ has.T
        near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        a, b = np.nonzero(np.triu(near, 1) & (label[:, None] != label[None, :]))
        parent = {x: x for x in label.tolist()}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = root(int(label[x])), root(int(label[y]))
            if p != q:
                parent[p] = q
                out.append((int(nodes[x]), int(nodes[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return link


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose estimate is not too far below it."""
    need = percent / 100.0
    floor = need - MARGIN * (need * (1 - need) / LANES) ** 0.5
    side = lambda s: classes.select(F.col("node").alias(s), F.col("signature").alias(f"signature_{s}"), F.col("n").alias(f"n_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.where(sizes & (estimated_similarity(F.col("signature_a"), F.col("signature_b")) >= floor)).select("a", "b")


def _sets(docs: DataFrame, classes: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """Full shingle sets of the classes that are in some bucket with others, made again from one text of each."""
    wanted = stage(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "digest", "id"))
    likely = may_hold(docs, "doc_id", wanted.select("id"), "_may").where("_may")
    texts = likely.join(wanted.select("id"), likely.doc_id.eqNullSafe(F.col("id")), "left_semi").select("text")
    made = texts.mapInArrow(_set_maker(width), "digest binary, shingles array<long>").groupBy("digest").agg(F.first("shingles").alias("shingles"))
    return stage(made.join(wanted.select("digest", "node"), "digest").select("node", "shingles"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")
