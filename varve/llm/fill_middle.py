"""Fill-in-middle: a text is cut into prefix, middle and suffix, which are written in an order that lets a model learn to fill gaps.

The cuts come from a hash of the id, so a rerun and a retried task agree. Per Arrow batch the texts become lists of units
(no bytes are copied), the lists are flattened with the index of their row, every unit gets its ordinal and from it a role,
the units of each role become lists again, and `binary_join` makes strings of them. A text beyond `PIECE` bytes is worked
off in pieces, whose strings are joined by row in the end, so memory does not follow the longest text's number of units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.llm.tables import columns_or_null
from varve.llm.words import PIECE, WHITE_SPACE, slices, text_buffer

PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
_EMPTY = pa.scalar("", pa.large_string())
UNITS = ("char", "word", "line")
_KIND = "doc_id long, n long, form string, prefix_units long, middle_units long, output string"


def unit_starts(data: np.ndarray, start: int, end: int, unit: str) -> np.ndarray:
    """By byte of `data[start:end]`, whether a unit begins there; where a row begins is not looked at.

    `char`: a code point. `word`: a word with the white space behind it (leading white space is a unit of its own).
    `line`: a line with its line break. Joined again, the units of a text are the text.
    """
    part = data[start:end]
    if unit == "char":
        return (part & 0xC0) != 0x80
    before = data[start - 1 : end - 1] if start else np.concatenate([np.array([0x41], np.uint8), part[:-1]])
    if unit == "word":
        return WHITE_SPACE[part] & ~WHITE_SPACE[before]
    return before == 0x0A


def _pieces(data: np.ndarray, offsets: np.ndarray, unit: str) -> Iterator[tuple[np.ndarray, int]]:
    """(unit starts, end) of stretches of about `PIECE` bytes that begin and end where units do."""
    at, last, size = int(offsets[0]), int(offsets[-1]), PIECE
    while at < last:
        to = min(at + size, last)
        begins = unit_starts(data, at, to, unit)
        begins[offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, to, "left")] - at] = True
        begins[0] = True
        starts = np.flatnonzero(begins) + at
        if to < last and len(starts) == 1:  # one endless unit
            size *= 2
            continue
        if to < last:
            to, starts = int(starts[-1]), starts[:-1]
        yield starts, to
        at, size = to, PIECE


def _string_list(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """`values` as lists, the i-th of `counts[i]` values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def cut_rows(column: pa.Array, h1: np.ndarray, h2: np.ndarray, unit: str = "char"):
    """Per row: number of units, units before the middle, units in it; and prefix, middle and suffix as string arrays."""
    data, offsets = text_buffer(column)
    rows = len(offsets) - 1
    n = np.zeros(rows, np.int64)
    for starts, _ in _pieces(data, offsets, unit):
        n += np.diff(np.searchsorted(starts, offsets))
    first, second = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(first, second), np.maximum(first, second)
    body, seen = pa.py_buffer(data), np.zeros(rows, np.int64)
    strings: list[list[pa.Array]] = [[], [], []]
    owners: list[np.ndarray] = []
    for starts, end in _pieces(data, offsets, unit):
        counts = np.diff(np.searchsorted(starts, offsets))
        here = np.flatnonzero(counts)
        counts = counts[here]
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, end)), body)
        lists = _string_list(units, counts)
        flat, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        ordinal = np.arange(len(flat)) - (np.cumsum(counts) - counts)[parent] + seen[here][parent]
        role = (ordinal >= low[here][parent]).astype(np.int8) + (ordinal >= high[here][parent])
        for r in range(3):
            mine = role == r
            kept = pc.filter(flat, pa.array(mine))
            strings[r].append(pc.binary_join(_string_list(kept, np.bincount(parent[mine], minlength=len(here))), _EMPTY))
        seen[here] += counts
        owners.append(here)
    by_row = np.bincount(np.concatenate(owners), minlength=rows) if owners else np.zeros(rows, np.int64)
    parts = [pc.binary_join(_string_list(pa.concat_arrays([*s, pa.array([], pa.large_string())]), by_row), _EMPTY) for s in strings]
    return n, low, high - low, parts


def _check_markers(markers: tuple[str, str, str]) -> None:
    """A marker may neither hold another one nor begin as one ends: then each is found only where it was written."""
    for a in markers:
        for b in markers:
            if not a or (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"markers {markers} cannot be told apart")


def _hash(seed: int, group: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long").alias(f"h{group + 1}")


def fill_in_middle(docs: DataFrame, unit: str = "char", share: int = 90, spm_share: int = 20, seed: int = 1, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) for each row of `docs(doc_id, text)`.

    `n` counts the text's units. Of four hashes of seed and doc_id, the first two choose the ends of prefix and middle, the
    third whether a text is cut (`share` percent are), the fourth whether the suffix comes first (`spm`, `spm_share` percent) or
    second (`psm`). A text that is null, empty or holds a marker stays as it is: form `plain`, its unit counts null, null
    as the empty text. A null doc_id is hashed as nothing behind the seed; repeated rows give equal rows; other columns are
    not looked at; an empty table gives no rows. Whole texts of any length are cut.
    """
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {UNITS}")
    _check_markers(markers)
    prefix, suffix, middle = (pa.scalar(m, pa.large_string()) for m in markers)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
            n, low, size, (before, inside, after) = cut_rows(text, h1, h2, unit)
            marked = np.zeros(len(n), bool)
            for m in markers:
                marked |= pc.match_substring(text, m).to_numpy(zero_copy_only=False)
            plain = (n == 0) | marked | (h3 % 100 >= share)
            spm = ~plain & (h4 % 100 < spm_share)
            psm_text = pc.binary_join_element_wise(prefix, before, suffix, after, middle, inside, _EMPTY)
            spm_text = pc.binary_join_element_wise(suffix, after, prefix, before, middle, inside, _EMPTY)
            output = pc.if_else(pa.array(plain), text, pc.if_else(pa.array(spm), spm_text, psm_text))
            form = pc.if_else(pa.array(plain), "plain", pc.if_else(pa.array(spm), "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), form, pa.array(low, mask=plain), pa.array(size, mask=plain), output.cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_units", "middle_units", "output"],
            )

    rows = columns_or_null(docs, doc_id="long", text="string")
    return rows.select("doc_id", "text", *[_hash(seed, g) for g in range(4)]).mapInArrow(transform, _KIND)


def restored(output: pa.Array, form: pa.Array, markers: tuple[str, str, str] = MARKERS) -> pa.Array:
    """The texts that `fill_in_middle` wrote as `output` in `form`."""
    prefix, suffix, middle = markers
    output, form = output.cast(pa.large_string()), form.to_numpy(zero_copy_only=False)
    parts, order = [], []
    for kind, first, second in (("plain", None, None), ("psm", prefix, suffix), ("spm", suffix, prefix)):
        where = np.flatnonzero(form == kind)
        rows = output.take(pa.array(where))
        if first is not None:
            rows = pc.list_element(pc.split_pattern(rows, first, max_splits=1), 1)
            halves = pc.split_pattern(rows, second, max_splits=1)
            tail = pc.split_pattern(pc.list_element(halves, 1), middle, max_splits=1)
            head, other, inner = pc.list_element(halves, 0), pc.list_element(tail, 0), pc.list_element(tail, 1)
            before, after = (head, other) if first == prefix else (other, head)
            rows = pc.binary_join_element_wise(before, inner, after, _EMPTY)
        parts.append(rows)
        order.append(where)
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order))))


def restore_middle(filled: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """`filled(output, form, ...)` with `restored`, the text before the cut, in place of any column of that name.

    A null output gives the empty text; a row whose form is none of the three is an error.
    """
    _check_markers(markers)

    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output"):
            text = restored(pc.fill_null(batch.column("output"), ""), batch.column("form"), markers)
            if len(text) != batch.num_rows:
                raise ValueError("a form is none of plain, psm, spm")
            yield pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.string())], names=[*batch.schema.names, "restored"])

    kept = filled.drop("restored")
    return kept.mapInArrow(undo, T.StructType([*kept.schema.fields, T.StructField("restored", T.StringType())]))
