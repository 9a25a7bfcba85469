"""Removal of long word sequences that occur more than once, found by recompression.

Rounds name runs of one word and then pairs of neighbouring symbols: whether a symbol opens or closes a pair in a round is
a hash of its name, and a pair's name is a hash of both, so equal stretches get equal symbols in every task without a
common dictionary. Each symbol also carries the words its making looked at; a symbol that looked at nothing outside a
window is the same in every occurrence of that window. The longest such symbol is the window's anchor: a window whose
anchor is unique in the corpus cannot repeat. Only the windows whose anchor is shared are then named by all their words (96 bits),
and those whose name is not theirs alone are the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.tables import columns_or_null
from varve.llm.words import SLICE, WHITE_SPACE, chain, mix, slices, split_words
from varve.session import stage

ROUNDS = 5


def recompress(words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the last round as (name, size, low, high), rows one after the other. A symbol stands for `size` words; its making looked at words [low, high).

    `first` has the row boundaries. What depends on a row's end reaches beyond it."""
    n = len(words)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    opens = np.ones(n, bool)
    opens[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(opens)
    end = np.append(at[1:], n)
    size = end - at
    name = np.where(size > 1, chain((words[at], size.astype(np.uint64))), words[at])
    row = row[at]
    head = np.ones(len(at), bool)
    head[1:] = row[1:] != row[:-1]
    tail = np.append(head[1:], True)
    low, high = at - 1, end + 1  # at a row's end this lies outside the row, and so outside its windows
    for k in range(rounds):
        if not len(name):
            break
        opener = (mix(name + np.uint64(k + 1)) >> np.uint64(63)).astype(bool)
        pair = np.zeros(len(name), bool)  # at the first symbol of a pair
        pair[:-1] = opener[:-1] & ~opener[1:] & ~tail[:-1]
        second = np.concatenate([[False], pair[:-1]])
        # An opener looks at its successor, a closer at its predecessor.
        new_high = np.where(opener & ~tail, np.maximum(high, np.append(high[1:], 0)), high)
        new_low = np.where(opener | head, low, np.minimum(low, np.append([0], low[:-1])))
        names = name.copy()
        merged = np.flatnonzero(pair)
        names[merged] = chain((name[merged], name[merged + 1]))
        tail = tail.copy()
        tail[merged] = tail[merged + 1]
        keep = ~second
        size[merged] += size[merged + 1]
        name, size, low, high, head, tail = names[keep], size[keep], new_low[keep], new_high[keep], head[keep], tail[keep]
    return name, size, low, high


def window_anchors(name: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Index of the anchor symbol of each window [start, start + width), -1 where no symbol lies inside."""
    if not len(name):
        return np.full(len(starts), -1)
    low, high = np.maximum.accumulate(low[::-1] * -1)[::-1] * -1, np.maximum.accumulate(high)
    a, b = np.searchsorted(low, starts, "left"), np.searchsorted(high, starts + width, "right")
    size = b - a
    # The symbol of most words, as it is the least likely to be shared by chance; then by hash.
    order = (mix(name) >> np.uint64(8)) | ((np.uint64(255) - np.minimum(words, 255).astype(np.uint64)) << np.uint64(56))
    out, span, step = np.full(len(starts), -1), np.arange(len(name)), 1
    level = np.where(size > 0, np.frexp(np.maximum(size, 1).astype(float))[1] - 1, -1)
    for k in range(int(level.max(initial=-1)) + 1):
        use = np.flatnonzero(level == k)
        x, y = span[a[use]], span[b[use] - step]
        # Ties are one name; the first place is taken, in every occurrence alike.
        out[use] = np.where(order[y] < order[x], y, x)
        if len(span) <= step:
            break
        left, right = span[:-step], span[step:]
        span = np.append(np.where(order[right] < order[left], right, left), span[-step:])
        step *= 2
    return out


def _window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Of all rows, the words at which a window begins."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    return np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def window_names(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of the words of each window."""
    out = []
    for salt in (0x51ED270B0A1F3F8D, 0xB492B66FBE98F273):
        value, total = mix(words + np.uint64(salt)), np.zeros(len(starts), np.uint64)
        for j in range(width):
            total = total * np.uint64(0xD6E8FEB86659FD93) + value[starts + j]
        out.append(mix(total).view(np.int64))
    return out[0], out[1]


def _indexer(width: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE // 2):
            words = split_words(part.column("text"), WHITE_SPACE)
            name, size, low, high = recompress(words.hash, words.first)
            starts = _window_starts(words.first, width)
            anchor = window_anchors(name, size, low, high, starts, width)
            row = np.searchsorted(words.first, starts, "right") - 1
            bare = np.bincount(row[anchor < 0], minlength=part.num_rows) > 0
            has = anchor >= 0
            used = np.unique(np.stack([row[has], anchor[has]], axis=1), axis=0)
            ends = np.searchsorted(used[:, 0], np.arange(part.num_rows + 1)).astype(np.int32)
            digests = [hashlib.sha256(b" ".join((t or "").encode().split())).digest() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(words.counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bare), pa.ListArray.from_arrays(pa.array(ends), pa.array(name[used[:, 1]].view(np.int64)))],
                names=["doc_id", "text_key", "n_words", "digest", "bare", "anchors"],
            )

    return index


def _candidates(part: pa.RecordBatch, width: int):
    """The words of a batch, its window starts and their rows, and which windows have a shared anchor or none."""
    words = split_words(part.column("text"), WHITE_SPACE)
    name, size, low, high = recompress(words.hash, words.first)
    starts = _window_starts(words.first, width)
    anchor = window_anchors(name, size, low, high, starts, width)
    row = np.searchsorted(words.first, starts, "right") - 1
    shared = part.column("shared")
    edges, values = shared.offsets.to_numpy(), shared.values.to_numpy(zero_copy_only=False).view(np.uint64)
    maybe = anchor < 0
    for i in range(part.num_rows):
        a, b = np.searchsorted(row, (i, i + 1))
        mine = anchor[a:b]
        maybe[a:b] |= (mine >= 0) & np.isin(name[mine], values[edges[i] : edges[i + 1]])
    return words, starts, row, maybe


def _namer(width: int):
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE // 2):
            words, starts, row, maybe = _candidates(part, width)
            h1, h2 = window_names(words.hash, starts[maybe], width)
            mine = row[maybe]
            rid, weight = part.column("rid").to_numpy()[mine], np.minimum(part.column("copies").to_numpy(), 2)[mine]
            at = starts[maybe] - words.first[mine]
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array((h2 >> 32).astype(np.int32)), pa.array(rid), pa.array(at, pa.int32()), pa.array(weight)], names=["h1", "h2", "rid", "at", "weight"])

    return names


def _cutter(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE // 2):
            words, starts, row, maybe = _candidates(part, width)
            spans, sizes, digests, texts = [], [], [], []
            for i, (text, single) in enumerate(zip(part.column("text").to_pylist(), part.column("single"))):
                a, b = np.searchsorted(row, (i, i + 1))
                at = starts[a:b][maybe[a:b]] - words.first[i]
                if single.is_valid:
                    at = np.setdiff1d(at, single.values.to_numpy(), assume_unique=True)
                jump = np.flatnonzero(np.diff(at) > width)
                a = at[np.concatenate([[0], jump + 1])] if len(at) else at
                b = at[np.append(jump, len(at) - 1)] + width if len(at) else at
                kept, parts, last = text.encode().split(), [], 0
                for x, y in zip(a.tolist(), b.tolist()):
                    parts += kept[last:x]
                    last = y
                kept = b" ".join(parts + kept[last:])
                spans.append(np.stack([a, b], axis=1).tolist())
                sizes.append(int((b - a).sum()))
                digests.append(hashlib.sha256(kept).digest())
                texts.append(kept.decode() if len(at) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("digest"), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(texts, pa.string())],
                names=["digest", "spans", "n_removed", "kept_digest", "kept_text"],
            )

    return cut


def substring_dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_words, spans, n_removed, kept_sha256, kept_text), one row per row of `docs(doc_id, text)`.

    A window is `width` consecutive words (split at ASCII white space, otherwise unchanged) of one document. A word is
    removed when a window over it also starts anywhere else, in the same document or another. `spans` are the removed
    word ranges [from, to), `kept_text` the kept words joined by one space (null where nothing is removed: the text is
    then kept as it is), `kept_sha256` the hash of the kept words joined by one space.

    Null and empty texts have no words. A text shorter than a window loses nothing. Repeated rows, null ids included,
    are copies of each other and lose all their words. Texts of any length are taken whole; extra columns are ignored.
    """
    docs = columns_or_null(docs, doc_id="long", text="string").withColumn("text_key", F.xxhash64("text"))
    index = docs.mapInArrow(_indexer(width), "doc_id long, text_key long, n_words long, digest binary, bare boolean, anchors array<long>")
    index = stage(index)

    # One row for each word sequence. Copies of it repeat each other whole; one of them is held against the rest.
    groups = index.where(F.col("n_words") >= width).groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("text_key", "doc_id")).alias("one"), F.first("bare").alias("bare"), F.first("anchors").alias("anchors")
    )
    groups = stage(groups.withColumn("rid", F.monotonically_increasing_id()))
    uses = groups.select("rid", F.explode("anchors").alias("name"))
    again = uses.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    shared = uses.join(again, "name").groupBy("rid").agg(F.collect_set("name").alias("shared"))
    held = groups.join(shared, "rid", "left").where("shared is not null or bare")
    held = held.select("rid", "digest", "copies", F.col("one.text_key").alias("text_key"), F.col("one.doc_id").alias("one_id"), F.coalesce("shared", F.array().cast("array<long>")).alias("shared"))
    same = (docs.text_key == held.text_key) & docs.doc_id.eqNullSafe(held.one_id)
    held = stage(docs.join(held, same).select("rid", "digest", "copies", "text", "shared"))

    # A name of one occurrence comes with its place; every other candidate window is a repeat.
    windows = held.select("rid", "copies", "text", "shared").mapInArrow(_namer(width), "h1 long, h2 int, rid long, at int, weight long")
    named = windows.groupBy("h1", "h2").agg(F.sum("weight").alias("n"), F.min("rid").alias("rid"), F.min("at").alias("at"))
    single = named.where("n = 1").groupBy("rid").agg(F.collect_list("at").alias("single"))
    alone = held.where("copies = 1").select("rid", "digest", "text", "shared")
    cut = alone.join(single, "rid", "left").select("digest", "text", "shared", "single").mapInArrow(_cutter(width), "digest binary, spans array<array<long>>, n_removed long, kept_digest binary, kept_text string")

    copied = groups.where("copies > 1").select("digest", F.lit(True).alias("copied"))
    known = copied.join(cut, "digest", "full")
    out = index.select("doc_id", "n_words", "digest").join(known, "digest", "left")
    copied = F.coalesce("copied", F.lit(False))
    nothing = F.array().cast("array<array<long>>")
    return out.select(
        "doc_id",
        "n_words",
        F.when(copied, F.array(F.array(F.lit(0).cast("long"), "n_words"))).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept_digest", "digest")))).alias("kept_sha256"),
        F.when(copied, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
