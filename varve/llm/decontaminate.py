"""Benchmark decontamination: an FM-index per training shard, searched backward for the windows of the benchmark.

A shard is a slice of a task's documents. Its words become numbers of the benchmark's vocabulary; stretches without a
foreign word that are at least as long as the shortest window are the indexed text, since no occurrence can lie elsewhere.
The documents stay where they are; only the benchmark, in blocks of bounded size, is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.fm_index import FMIndex
from varve.llm.tables import columns_or_null
from varve.llm.words import ALPHANUMERIC, slices, split_words, text_buffer
from varve.session import stage

#: Benchmark bytes in one broadcast block; a larger benchmark takes more blocks, each one more pass over the documents.
BLOCK_BYTES = 32 << 20


@dataclass
class Windows:
    vocabulary: np.ndarray  # sorted word hashes; word i is symbol i + 1
    patterns: np.ndarray  # distinct windows, rows padded with 0
    lengths: np.ndarray
    item_of: np.ndarray  # items of each pattern, one pattern after the other
    items_from: np.ndarray
    item_ids: list[str | None]


def compile_windows(item_ids: list, texts: pa.Array, width: int) -> Windows:
    words = split_words(texts, ALPHANUMERIC, fold=True)
    vocabulary, symbol = np.unique(words.hash, return_inverse=True)
    rows, lengths, items = [], [], []
    for item, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
        if b > a:
            size = min(width, b - a)
            here = np.lib.stride_tricks.sliding_window_view(symbol[a:b] + 1, size)
            rows.append(np.pad(here, ((0, 0), (0, width - size))))
            lengths += [size] * len(here)
            items += [item] * len(here)
    if not rows:
        return Windows(vocabulary, np.zeros((0, width), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), item_ids)
    patterns, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.reshape(-1), np.array(items)], axis=1), axis=0)
    return Windows(vocabulary, patterns, (patterns > 0).sum(axis=1), pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)), item_ids)


def find_windows(texts: pa.Array, windows: Windows) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set]]:
    """Per text: its word count, the merged word spans [from, to) that windows cover, and the numbers of the items found."""
    words = split_words(texts, ALPHANUMERIC, fold=True)
    n_rows, n = len(words.first) - 1, len(words.hash)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_rows)]
    found: list[set] = [set() for _ in range(n_rows)]
    if not n or not len(windows.patterns):
        return words.counts, spans, found
    place = np.searchsorted(windows.vocabulary, words.hash)
    known = windows.vocabulary[np.minimum(place, len(windows.vocabulary) - 1)] == words.hash
    symbol = np.where(known, place + 1, 0)
    row = np.repeat(np.arange(n_rows), words.counts)
    breaks = np.ones(n + 1, bool)
    breaks[1:n] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
    edges = np.flatnonzero(breaks)
    start, end = edges[:-1], edges[1:]
    use = known[start] & (end - start >= windows.lengths.min())
    start, size = start[use], (end - start)[use]
    if not len(start):
        return words.counts, spans, found
    # The indexed text: the stretches one after the other, each closed by a separator.
    at = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(at[-1], np.int64)
    word_at = np.full(at[-1], -1, np.int64)
    inner = np.ones(at[-1], bool)
    inner[at[1:] - 1] = False
    word_at[inner] = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    text[inner] = symbol[word_at[inner]]
    index = FMIndex(text, len(windows.vocabulary))
    low, high = index.search(windows.patterns, windows.lengths)
    hit = np.flatnonzero(high > low)
    many = high[hit] - low[hit]
    pattern = np.repeat(hit, many)
    suffix = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    begin = word_at[index.locate(suffix)]
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, begin, 1)
    np.add.at(covered, begin + windows.lengths[pattern], -1)
    inside = np.cumsum(covered)[:-1] > 0
    left = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | (row[1:] != row[:-1])]))
    right = np.flatnonzero(inside & np.concatenate([~inside[1:] | (row[1:] != row[:-1]), [True]])) + 1
    for a, b in zip(left.tolist(), right.tolist()):
        r = row[a]
        spans[r].append((a - int(words.first[r]), b - int(words.first[r])))
    for r, p in np.unique(np.stack([row[begin], pattern], axis=1), axis=0).tolist() if len(begin) else []:
        found[r].update(windows.item_of[windows.items_from[p] : windows.items_from[p + 1]].tolist())
    return words.counts, spans, found


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, width: int) -> Iterator[Windows]:
    """The compiled windows of `benchmark(item_id, text)`, a bounded block of whole items at a time."""
    items = columns_or_null(benchmark, item_id="string", text="string").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-2 * size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    if blocks > 1:
        items = stage(items)
    for k in range(blocks):
        table = items.where(block == k).toArrow()
        yield compile_windows(table["item_id"].to_pylist(), table["text"].combine_chunks(), width)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of `docs` with `n_words`, `spans` (merged word ranges [from, to) to remove), `n_hit` and `items` (sorted ids found).

    Words are runs of ASCII letters or digits, A-Z lower-cased, and of anything beyond ASCII. A window is `width`
    consecutive words of an item; an item of fewer words, but not none, is one window. Null and empty texts have no
    words and no hits; a null item text is no item, and an item with a null id covers words but is not listed.
    Repeated items count once; repeated rows give repeated rows. Columns of `docs` named like a result are replaced.
    """
    if "text" not in docs.columns:
        docs = docs.withColumn("text", F.lit(None).cast("string"))
    docs = docs.select(*[c for c in docs.columns if c not in ("n_words", "spans", "n_hit", "items")])
    out = docs.withColumn("n_words", F.lit(0).cast("long")).withColumn("spans", F.array().cast("array<array<long>>")).withColumn("items", F.array().cast("array<string>"))
    for windows in benchmark_blocks(benchmark, width):
        shared = docs.sparkSession.sparkContext.broadcast(windows)
        out = out.mapInArrow(_searcher(shared), out.schema)
    return out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]))


def _searcher(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, spans, found = find_windows(batch.column("text"), shared.value)
            ids = shared.value.item_ids
            items = [sorted({*old, *(ids[i] for i in new if ids[i] is not None)}) for old, new in zip(batch.column("items").to_pylist(), found)]
            spans = [_merge([*map(tuple, old), *new]) for old, new in zip(batch.column("spans").to_pylist(), spans)]
            put = {"n_words": pa.array(counts, pa.int64()), "spans": pa.array([[list(s) for s in x] for x in spans], pa.list_(pa.list_(pa.int64()))), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([put.get(name, column) for name, column in zip(batch.schema.names, batch.columns)], names=batch.schema.names)

    return search


def remove_spans(found: DataFrame) -> DataFrame:
    """`found` from `contamination` with the covered words cut from `text`; what stands between kept words stays as it was.

    A text of which no word is left becomes empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            words = split_words(batch.column("text"), ALPHANUMERIC, fold=True)
            _, offsets = text_buffer(batch.column("text"))
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    raw, base, first = texts[i].encode(), int(offsets[i]), int(words.first[i])
                    keep, at = [], 0
                    for a, b in spans:
                        keep.append(raw[at : int(words.start[first + a]) - base])
                        at = int(words.end[first + b - 1]) - base
                    keep.append(raw[at:])
                    texts[i] = b"".join(keep).decode() if sum(b - a for a, b in spans) < words.counts[i] else ""
            yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if n == "text" else c for n, c in zip(batch.schema.names, batch.columns)], names=batch.schema.names)

    return found.mapInArrow(cut, found.schema)

