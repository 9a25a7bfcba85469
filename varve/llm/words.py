"""Words of an Arrow text column as arrays: hashes and byte spans, without a Python object per word.

A word's hash depends on its bytes alone, so equal words agree between tasks and runs. Texts are worked off
in pieces of bounded size, and a batch in slices of bounded size, so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SLICE = 4 << 20

WHITE_SPACE = np.ones(256, bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII digits and lower-case letters (after folding) and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_SALT = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(columns: Iterable[np.ndarray]) -> np.ndarray:
    """One hash per position of several equally long arrays; their order counts."""
    out = None
    for c in columns:
        out = mix(c) if out is None else mix(out * np.uint64(0x2545F4914F6CDD1D) + c)
    return out


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        if size > 8 * PIECE:  # one endless word; not worth keeping
            return tables[0], tables[1]
        _powers = (tables[0], tables[1])
    return _powers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at most `limit` text bytes (a longer text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """`hash`, `start`, `end`: per word. `first`: per row, the index of its first word, and the word count at the end."""

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(column: pa.Array, inside: np.ndarray = WHITE_SPACE, fold: bool = False) -> Words:
    """`inside`: by byte, whether it belongs to a word. `fold` lower-cases A-Z before that test."""
    data, offsets = text_buffer(column)
    letter = inside[_FOLD] if fold else inside
    value = mix(_SALT)[_FOLD] if fold else mix(_SALT)
    parts, at, last = [], int(offsets[0]), int(offsets[-1])
    while at < last:
        to = min(at + PIECE, last)
        if to < last:  # end where a word ends: at a row's end or in a gap between words
            row = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            gap = np.flatnonzero(~letter[data[max(row, at) : to]])
            if len(gap):
                to = max(row, at) + int(gap[-1]) + 1
            elif row > at:
                to = row
            else:
                end = int(offsets[np.searchsorted(offsets, to, "left")])
                while to < end and letter[data[to]]:
                    step = np.flatnonzero(~letter[data[to : min(end, to + PIECE)]])
                    to = to + int(step[0]) if len(step) else min(end, to + PIECE)
        parts.append(_piece(data, at, to, offsets, letter, value))
        at = to
    if parts:
        hashes, starts, ends = (np.concatenate(x) for x in zip(*parts))
    else:
        hashes, starts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Words(data, hashes, starts, ends, np.searchsorted(starts, offsets, "left"))


def _piece(data, at: int, to: int, offsets, letter, value):
    raw = data[at:to]
    is_word = letter[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = is_word[:-1]
    rows = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, to, "left")] - at
    before[rows] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    after[rows[rows > 0] - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value[raw] * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), starts + at, ends + at
