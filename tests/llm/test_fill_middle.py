"""Fill-in-middle against plain string slicing, and its way back."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from varve.llm import fill_middle
from varve.llm.fill_middle import MARKERS, UNITS, cut_rows, fill_in_middle, restore_middle, restored

SPLIT = {"char": r"(?s).", "line": r"[^\n]*\n|[^\n]+", "word": r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"}
TEXTS = ["héllo wörld\nline two  x", "", None, "a", "  lead\n\nz ", "👍é́" * 5, "x<P>y", "<S", "\n", "e" * 50, "<P", "a<M", " ", "\x00 \x85 é"]
KIND = "doc_id long, text string, n string, form string, output string, restored string, h1 string"


def by_hand(doc_id, text, unit="char", seed=1, share=90, spm_share=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(SPLIT[unit], text)
    assert "".join(units) == text
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= share:
        return doc_id, n, "plain", None, None, text, text
    if h4 % 100 < spm_share:
        return doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}", text


def rows_of(frame):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output, r.restored) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("unit", UNITS)
@pytest.mark.parametrize("piece", [1 << 20, 7, 1])
def test_units_and_cuts(unit, piece, monkeypatch):
    monkeypatch.setattr(fill_middle, "PIECE", piece)
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(60))) for _ in range(40)]
    import numpy as np

    h1, h2 = (np.array([rng.randrange(2**32) for _ in texts]) for _ in range(2))
    # a slice of a larger array: offsets do not begin at zero
    n, low, size, parts = cut_rows(pa.array(["skip", *texts])[1:], h1, h2, unit)
    for i, text in enumerate(texts):
        units = re.findall(SPLIT[unit], text or "")
        a, b = sorted((int(h1[i]) % (len(units) + 1), int(h2[i]) % (len(units) + 1)))
        assert (n[i], low[i], size[i]) == (len(units), a, b - a)
        assert [p[i].as_py() for p in parts] == ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]


@pytest.mark.parametrize("unit", UNITS)
def test_matches_slicing_on_odd_rows(spark, unit):
    rng = random.Random(6)
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(3, "twice"), (3, "twice"), (None, "no id"), (None, None), (-7, "below zero")]
    rows.append((5000, "".join(rng.choice("abc dé👍\n") for _ in range(3_000_000))))  # longer than a piece and than a slice
    frame = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], KIND).repartition(3)
    got = restore_middle(fill_in_middle(frame, unit=unit))
    want = sorted((by_hand(*r, unit=unit) for r in rows), key=repr)
    assert rows_of(got) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_shares_seeds_and_markers(spark):
    frame = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    every = {r.form for r in fill_in_middle(frame, share=100, spm_share=0).collect()}
    assert every == {"psm"}
    assert {r.form for r in fill_in_middle(frame, share=0).collect()} == {"plain"}
    first, second = ({r.output for r in fill_in_middle(frame, seed=s).collect()} for s in (1, 2))
    assert first != second
    own = ("[pre]", "[suf]", "[mid]")
    back = restore_middle(fill_in_middle(frame, markers=own, share=100), markers=own)
    assert all(r.restored == f"text {r.doc_id}" and r.output.count("[mid]") == 1 for r in back.collect())
    for bad in [("<P>", "<P>", "<M>x<P>"), ("aba", "b", "c"), ("", "b", "c"), ("<<", ">", "x<")]:
        with pytest.raises(ValueError):
            fill_in_middle(frame, markers=bad)
    with pytest.raises(ValueError):
        fill_in_middle(frame, unit="grapheme")


def test_no_rows_and_no_columns(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    bare = restore_middle(fill_in_middle(spark.createDataFrame([(1,)], "doc_id long"))).collect()
    assert [(r.n, r.form, r.output, r.restored) for r in bare] == [(0, "plain", "", "")]


def test_markers_at_the_seams():
    """Pieces that end as a marker begins do not move the place where the marker is found."""
    output = pa.array(["<P>a<<S><S<M>b", "<S><M<P>x<S<M><P", "as it is"])
    assert restored(output, pa.array(["psm", "spm", "plain"])).to_pylist() == ["a<b<S", "x<S<P<M", "as it is"]
