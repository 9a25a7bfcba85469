"""The k best documents of each item under an integer BM25, by a search through two trees at once.

One pass over the texts keeps, per document, its length and its counts of terms that items have; statistics come from that table,
and so does the search, so texts are cut into terms once for each block of items (16 MB of item text).

A task reads its documents shard by shard. The items and the shard's documents each form a tree whose nodes are contiguous
in an order of halves: a set is halved by how much closer its members are to one of two unlike members than to the other. A node holds, for each
term, the maximum of its members: weights on the item side, what a term adds to a score on the document side. The product of an item
node and a document node is then a bound for all their scores. Pairs of nodes are met level by level, and a pair goes, with all pairs
below it, once its bound is less than the weakest k-th score among the node's items. Leaves that promise most come first, so
those scores rise early; they carry over to the task's next shards. Nothing is estimated: what is left is scored in whole numbers, equal
scores stay in until their doc_id decides, and a task sends k rows an item at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.tables import columns_or_null
from varve.llm.words import slices, text_buffer
from varve.session import stage

#: Bytes of item text a pass; items in a branch of the item tree; documents, and items, below the lowest node; children of a node.
BLOCK_BYTES, BRANCH, LEAF, FAN = 16 << 20, 256, 16, 8
#: Documents a shard, or cells of its leaves' maxima, whichever is less.
SHARD, CELLS = 8192, 8 << 20
PIECE = 1 << 20

#: ASCII letters small, other ASCII than letters and digits a space, everything beyond ASCII as it is.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


# ---- terms


def term_lists(column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row, term) of all terms of a text column, a few MB of text at a time; a long text comes in parts, cut between terms."""
    data, offsets = text_buffer(column)
    lo, hi = int(offsets[0]), int(offsets[-1])
    folded = _FOLD[data[lo:hi]]
    bounds, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = offsets - lo
    for row in np.flatnonzero(np.diff(ends) > PIECE).tolist():
        cuts, at, end = [], int(ends[row]) + PIECE, int(ends[row + 1])
        while at < end:
            step = np.flatnonzero(folded[at : min(at + PIECE, end)] == 0x20)
            if len(step):
                cuts.append(at + int(step[0]))
                at = cuts[-1] + PIECE
            else:
                at += PIECE
        bounds.append(np.array(cuts, np.int64))
        owner.append(np.full(len(cuts), row))
    starts = np.concatenate([ends[:-1], *bounds])
    rows = np.concatenate([np.arange(len(ends) - 1), *owner])
    order = np.lexsort((starts, rows))
    starts, rows = np.append(starts[order], hi - lo), rows[order]
    body, at = pa.py_buffer(folded), 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + 4 * PIECE, "right")) - 1)
        lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(to - at, pa.py_buffer(starts[at : to + 1].copy()), body))
        flat, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        some = pc.greater(pc.binary_length(flat), 0)
        yield rows[at:to][parent[some.to_numpy(zero_copy_only=False)]], pc.filter(flat, some)
        at = to


def count_terms(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms a row, and (row, index in `vocabulary`, occurrences) sorted by row and index."""
    n, keys, counts, size = np.zeros(len(column), np.int64), [], [], max(1, len(vocabulary))
    for row, term in term_lists(column):
        n += np.bincount(row, minlength=len(column))
        code = pc.fill_null(pc.index_in(term, value_set=vocabulary), -1).to_numpy()
        key, many = np.unique((row * size + code)[code >= 0], return_counts=True)
        keys.append(key)
        counts.append(many)
    if not keys:
        return n, *(np.zeros(0, np.int64),) * 3
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
    return n, key // size, key % size, total


# ---- trees


@dataclass
class Rows:
    """Sparse rows: row i has `term[first[i]:first[i + 1]]` with `value` alike."""

    first: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.first)[rows]
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.first[rows] - first[:-1], size) + np.arange(first[-1])
        return Rows(first, self.term[at], self.value[at])

    def dot(self, vector: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(vector[self.term] * self.value)])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def dense(self, width: int, kind) -> np.ndarray:
        out = np.zeros((len(self), width), kind)
        out[self.owner(), self.term] = self.value
        return out


def halved_order(rows: Rows, width: int, leaf: int) -> np.ndarray:
    """An order that keeps like rows together: sets are halved down to `leaf` rows, at multiples of `leaf`."""
    out, stack = [], [np.arange(len(rows))]
    while stack:
        mine = stack.pop()
        if len(mine) <= leaf:
            out.append(mine)
            continue
        part = rows.take(mine)
        norm = np.sqrt(np.maximum(np.bincount(part.owner(), weights=part.value.astype(float) ** 2, minlength=len(part)), 1e-300))

        def likeness(i: int) -> np.ndarray:
            vector = np.zeros(width)
            a, b = part.first[i], part.first[i + 1]
            vector[part.term[a:b]] = part.value[a:b]
            return part.dot(vector) / norm / norm[i]

        one = int(np.argmin(likeness(0)))
        to_one = likeness(one)
        order = np.argsort(to_one - likeness(int(np.argmin(to_one))), kind="stable")
        cut = leaf * max(1, round(len(mine) / leaf / 2))
        stack += [mine[order[cut:]], mine[order[:cut]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _levels(lowest: np.ndarray) -> list[np.ndarray]:
    """Maxima of `FAN` nodes each, from the lowest level up to one of at most `FAN` nodes."""
    levels = [lowest]
    while len(levels[-1]) > FAN:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN), axis=0))
    return levels


@dataclass
class Branch:
    """A subtree of the item tree: `terms` it knows, weights of its items on them, and maxima by level."""

    items: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    levels: list[np.ndarray]


def item_branches(weights: Rows, width: int) -> list[Branch]:
    """The item tree, cut where a subtree has at most `BRANCH` items; items without weight are in none."""
    some = np.flatnonzero(np.diff(weights.first) > 0)
    order = some[halved_order(weights.take(some), width, LEAF)]
    out = []
    for at in range(0, len(order), BRANCH):
        items = order[at : at + BRANCH]
        part = weights.take(items)
        terms = np.unique(part.term)
        # Sums stay whole numbers below 2**53 in floats; beyond, 64-bit integers take over, which are slower.
        most = 1_000_000 * int(np.bincount(part.owner(), weights=part.value.astype(float)).max())
        dense = Rows(part.first, np.searchsorted(terms, part.term), part.value).dense(len(terms), np.float64 if most < 1 << 53 else np.int64)
        dense = np.asfortranarray(dense)  # the rows of its transpose are read one by one
        out.append(Branch(items, terms, dense, _levels(np.maximum.reduceat(dense, np.arange(0, len(dense), FAN), axis=0))))
    return out


class TopK:
    """The k best (score, doc_id) of each item so far; a null doc_id comes after all others of its score."""

    def __init__(self, items: int, k: int):
        self.score, self.id, self.null = np.zeros((items, k), np.int64), np.zeros((items, k), np.int64), np.zeros((items, k), bool)

    @property
    def weakest(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """`scores`: by item of `items` and document of `ids`."""
        i, j = np.nonzero((scores >= np.maximum(self.weakest[items], 1)[:, None]))
        if not len(i):
            return
        here, k = np.unique(i), self.score.shape[1]
        old = items[here]
        who = np.concatenate([np.repeat(old, k), items[i]])
        score = np.concatenate([self.score[old].ravel(), scores[i, j].astype(np.int64)])
        doc = np.concatenate([self.id[old].ravel(), ids[j]])
        null = np.concatenate([self.null[old].ravel(), nulls[j]])
        order = np.lexsort((doc, null, -score, who))
        who = who[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who, "left")
        keep = order[rank < k]
        who, rank = who[rank < k], rank[rank < k]
        self.score[who, rank], self.id[who, rank], self.null[who, rank] = score[keep], doc[keep], null[keep]


def search_shard(branches: list[Branch], docs: Rows, ids: np.ndarray, nulls: np.ndarray, width: int, best: TopK) -> int:
    """Meet the item tree with the tree of `docs` (rows of what a term adds); returns how many pairs were scored."""
    order = halved_order(docs, width, LEAF)
    docs, ids, nulls = docs.take(order), ids[order], nulls[order]
    leaves = -(-len(docs) // LEAF)
    key = docs.owner() // LEAF * width + docs.term
    by_key = np.argsort(key, kind="stable")
    firsts = np.flatnonzero(np.diff(key[by_key], prepend=-1))
    leaf_key, leaf_most = key[by_key][firsts], np.maximum.reduceat(docs.value[by_key], firsts) if len(firsts) else np.zeros(0, np.int64)
    scored = 0
    for branch in branches:
        place = np.full(width, -1)
        place[branch.terms] = np.arange(len(branch.terms))
        known = place[leaf_key % width] >= 0
        lowest = np.zeros((leaves, len(branch.terms)), branch.weights.dtype)
        lowest[leaf_key[known] // width, place[leaf_key[known] % width]] = leaf_most[known]
        scored += _descend(branch, _levels(lowest), docs, place, ids, nulls, best)
    return scored


def _weakest_below(weakest: np.ndarray, levels: int) -> list[np.ndarray]:
    out = [weakest]
    for _ in range(levels):
        out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), FAN)))
    return out


def _descend(branch: Branch, doc_levels: list[np.ndarray], docs: Rows, place: np.ndarray, ids: np.ndarray, nulls: np.ndarray, best: TopK) -> int:
    item_levels = [branch.weights, *branch.levels]
    weakest = _weakest_below(best.weakest[branch.items], len(branch.levels))
    i, d = len(item_levels) - 1, len(doc_levels) - 1
    alive = np.ones((len(item_levels[i]), len(doc_levels[d])), bool)
    while True:
        mine = np.flatnonzero(alive.any(axis=0))
        theirs = np.flatnonzero(alive.any(axis=1))
        if not len(mine):
            return 0
        bound = np.zeros(alive.shape, branch.weights.dtype)
        bound[np.ix_(theirs, mine)] = item_levels[i][theirs] @ doc_levels[d][mine].T
        alive &= bound >= np.maximum(weakest[i], 1)[:, None]
        if i == 0 and d == 0:
            break
        if d > 0:
            d -= 1
            alive = np.repeat(alive, FAN, axis=1)[:, : len(doc_levels[d])]
        if i > 0:
            i -= 1
            alive = np.repeat(alive, FAN, axis=0)[: len(item_levels[i])]
    bound[~alive] = 0
    promise = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1).min(axis=0)
    queue = np.lexsort((-bound.max(axis=0), promise))
    queue = queue[bound[:, queue].any(axis=0)]
    by_term, scored = branch.weights.T, 0
    for leaf in queue.tolist():
        rows = np.flatnonzero(bound[:, leaf] >= np.maximum(best.weakest[branch.items], 1))
        if not len(rows):
            continue
        mine = slice(leaf * LEAF, min(leaf * LEAF + LEAF, len(docs)))
        inner = slice(docs.first[mine.start], docs.first[mine.stop])
        column = place[docs.term[inner]]
        owner = np.repeat(np.arange(mine.stop - mine.start), np.diff(docs.first[mine.start : mine.stop + 1]))
        known = column >= 0
        used, column = np.unique(column[known], return_inverse=True)
        dense = np.zeros((len(used), mine.stop - mine.start), branch.weights.dtype)
        dense[column, owner[known]] = docs.value[inner][known]
        best.add(branch.items[rows], by_term[used][:, rows].T @ dense, ids[mine], nulls[mine])
        scored += len(rows) * (mine.stop - mine.start)
    return scored


# ---- scores


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def added(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a score for each unit of its weight; `n`: the document's terms, for each `tf`."""
    if 75 * int(n.max(initial=0)) * n_docs < 1 << 63:
        m = 25 + 75 * n * n_docs // max(1, n_terms)
    else:
        m = np.array([25 + 75 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _posting_maker(vocabulary) -> Callable:
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, row, term, tf = count_terms(batch.column("text"), vocabulary.value)
            where = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(where, pa.array(x, pa.int32())) for x in (term, tf)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return postings


def _term_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        more = np.bincount(batch.column("terms").flatten().to_numpy())
        if len(more) > len(total):
            total, more = more, total
        total[: len(more)] += more
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["term", "df"])


def _searcher(shared, k: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branches, width, items, n_docs, n_terms = shared.value
        best = TopK(items, k)
        widest = max(len(b.terms) for b in branches)
        shard = min(SHARD, LEAF * max(1, CELLS // widest))
        held, rows = [], 0

        def run() -> None:
            batch = pa.Table.from_batches(held).combine_chunks()
            ids, n = batch.column("doc_id").combine_chunks(), batch.column("n").to_numpy()
            terms, tfs = batch.column("terms").combine_chunks(), batch.column("tfs").combine_chunks()
            size = pc.list_value_length(terms).to_numpy()
            value = added(tfs.flatten().to_numpy().astype(np.int64), np.repeat(n, size), n_docs, n_terms)
            docs = Rows(np.concatenate([[0], np.cumsum(size)]), terms.flatten().to_numpy().astype(np.int64), value)
            search_shard(branches, docs, pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False), width, best)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, shard - rows)
                held.append(part)
                rows, at = rows + part.num_rows, at + part.num_rows
                if rows == shard:
                    run()
                    held, rows = [], 0
        if rows:
            run()
        item, rank = np.nonzero(best.score)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(best.id[item, rank], mask=best.null[item, rank]), pa.array(best.score[item, rank])], names=["item", "doc_id", "score"]
        )

    return search


def _block_top_k(docs: DataFrame, block: pa.Table, k: int) -> DataFrame | None:
    """(item_id, item, doc_id, score): for each item of `block` the best of every task."""
    spark = docs.sparkSession
    texts = block.column("text").combine_chunks()
    found = [term for _, term in term_lists(texts)]
    vocabulary = pc.unique(pa.concat_arrays([*found, pa.array([], pa.large_string())]))
    if not len(vocabulary):
        return None
    postings = stage(docs.mapInArrow(_posting_maker(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms array<int>, tfs array<int>"))
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    counts = postings.select("terms").mapInArrow(_term_counter, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
    _, item, term, qtf = count_terms(texts, vocabulary)
    worth = term_weights(df, n_docs)[term] * qtf
    use = (worth > 0) & (df[term] > 0)
    weights = Rows(np.searchsorted(item[use], np.arange(len(texts) + 1)), term[use], worth[use])
    branches = item_branches(weights, len(vocabulary))
    if not branches:
        return None
    shared = spark.sparkContext.broadcast((branches, len(vocabulary), len(texts), n_docs, n_terms))
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(texts)), pa.int32()), "item_id": block.column("item_id")}))
    return postings.select("doc_id", "n", "terms", "tfs").mapInArrow(_searcher(shared, k), "item int, doc_id long, score long").join(names, "item")


def dual_tree_top_k(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item of `items(item_id, text)` its k best rows of `docs(doc_id, text)`.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z made small. With N documents that have a term, L
    terms in all, n in a document, a term weighs floor(1000 ln((2N+2)/(2df+1))) for each time the item has it, and a document
    adds (10^9 tf) div (1000 tf + 8 (25 + (75 n N) div L)) for each unit of weight, in 64-bit integers. Scores of zero are left out;
    equal scores go by ascending doc_id, null last; ranks of an item are 1, 2, ... A null text has no terms. Each row of `docs` is a document
    (repeated rows take a rank each); equal rows of `items` count once, and rows of one item_id and different
    texts each have their own ranks. Whole texts count; other columns are not looked at; empty tables give no rows.
    """
    rows = columns_or_null(docs, doc_id="long", text="string")
    asked = columns_or_null(items, item_id="long", text="string").where("text is not null").distinct()
    asked = stage(asked.withColumn("size", F.octet_length("text").cast("long")))
    total = asked.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    blocks, found = math.ceil(total / block_bytes), []
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text").toArrow()
        best = _block_top_k(rows, mine, k) if mine.num_rows else None
        if best is not None:
            found.append(best.withColumn("block", F.lit(b)))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
