"""Bijections of slots, and what is computed with them, against plain Python and numpy."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from varve.models import regression as R
from varve.operators import shuffles as S


def donor_by_hand(slot, n, perm, seed=42, tag="perm"):
    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, v = (1 << bits) - 1, slot
    while True:
        left, right = v >> bits, v & mask
        for r in range(6):
            key = int(hashlib.md5(f"{seed}|{tag}|{perm}|{r}".encode()).hexdigest()[:8], 16) & (2**31 - 1)
            left, right = right, left ^ (((((right + key) & (2**31 - 1)) * 1103515245) >> 15) & mask)
        v = (left << bits) | right
        if v < n:
            return v


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 100, 257, 1000])
def test_every_permutation_is_a_bijection(n):
    keys = S.round_keys(20)
    got = S.donors(np.arange(n), n, keys)
    assert (np.sort(got, axis=0) == np.arange(n)[:, None]).all()
    for slot in {0, n // 2, n - 1}:
        assert [donor_by_hand(slot, n, j) for j in range(20)] == got[slot].tolist()


def test_donors_look_random():
    """Over 4,000 permutations of 7 slots: every slot meets every donor about equally often, and so do pairs of neighbours."""
    got = S.donors(np.arange(7), 7, S.round_keys(4000))
    counts = np.array([np.bincount(got[i], minlength=7) for i in range(7)])
    assert np.abs(counts - 4000 / 7).max() < 6 * np.sqrt(4000 / 7)
    pairs = np.bincount(got[0] * 7 + got[1], minlength=49).reshape(7, 7)
    assert (np.diag(pairs) == 0).all() and np.abs(pairs[~np.eye(7, dtype=bool)] - 4000 / 42).max() < 6 * np.sqrt(4000 / 42)
    many = S.donors(np.arange(1000), 1000, S.round_keys(300))
    r = np.array([np.corrcoef(np.arange(1000), many[:, j])[0, 1] for j in range(300)])
    assert abs(r.mean()) < 0.01 and r.std() == pytest.approx(1 / np.sqrt(999), rel=0.15)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(90), "g": rng.choice(["a", "b", None], 90), "x": rng.normal(size=90), "z": 1.0, "y": rng.normal(size=90)})
    pdf.loc[3, "y"] = np.nan
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pdf)
    return df.withColumn("y", F.when(~F.isnan("y"), F.col("y")))


def slots_by_hand(pdf):
    order = sorted(pdf.index, key=lambda i: (hashlib.md5(f"42|order|{pdf.id[i]}".encode()).hexdigest(), pdf.id[i]))
    return pd.Series(range(len(pdf)), index=order)


@pytest.mark.parametrize("shared", [True, False])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_null_correlations(table, groups, shared, monkeypatch):
    if not shared:
        monkeypatch.setattr(S, "SHARED_VALUES", 10)
    got = S.shuffled_correlations(table, "id", ["x", "z"], "y", 12, groups).toPandas()
    pdf = table.toPandas().dropna(subset=["y"])
    parts = [(None, pdf)] if not groups else [(g, pdf[pdf.g.isna() if pd.isna(g) else pdf.g == g]) for g in pdf.g.unique()]
    assert len(got) == 24 * len(parts) and got[got.feature == "z"].r.isna().all()
    for g, part in parts:
        slots = slots_by_hand(part)
        at = {s: i for i, s in slots.items()}
        mine = got if g is None and not groups else got[got.g.isna() if pd.isna(g) else got.g == g]
        mine = mine[mine.feature == "x"].set_index("perm").r
        for j in range(12):
            y = [part.y[at[donor_by_hand(int(slots[i]), len(part), j)]] for i in part.index]
            assert mine[j] == pytest.approx(np.corrcoef(part.x, y)[0, 1])


def test_permuted_study_equals_refitting_shuffled_rows(spark):
    """r of a permutation is that of the whole nested study on rows whose target was shuffled so."""
    rng = np.random.default_rng(7)
    n = 150
    pdf = pd.DataFrame(rng.normal(size=(n, 2)), columns=["a", "b"]).assign(id=np.arange(n), site=[f"s{i % 2}" for i in range(n)], age=rng.normal(size=n))
    pdf["y"] = pdf.a + 0.3 * pdf.age + rng.normal(size=n)
    spec = R.Spec("id", "y", ("a", "b"), "site", ("age",), ("age",), folds=3)
    df = spark.createDataFrame(pdf)
    null, p = R.permutation_null(df, spec, 25)
    null = null.toPandas().set_index("draw").pearson_r
    prepared = R.prepare(df, spec)
    rows = prepared.rows.toPandas()
    slots = slots_by_hand(rows)
    at = {s: i for i, s in slots.items()}
    for j in (0, 17):
        moved = rows.assign(y=[rows.y[at[donor_by_hand(int(slots[i]), n, j)]] for i in rows.index])
        again = R.Prepared(spark.createDataFrame(moved), spec, prepared.harm, prepared.resid)
        assert null[f"perm{j}"] == pytest.approx(R.pooled(again, again.frame()).first()["pearson_r"], abs=1e-9)
    seen = p.first()
    assert seen["observed"] == pytest.approx(R.pooled(prepared, prepared.frame()).first()["pearson_r"])
    assert seen["p"] == pytest.approx((1 + (null.abs() >= abs(seen["observed"])).sum()) / 26)


def test_memory_of_shuffled_targets_does_not_follow_the_rows(spark):
    """The temporary matrices of a task's donors are bounded; only the targets themselves grow with the rows given."""
    import tracemalloc

    from varve.operators.shuffles import number_rows, shuffled_targets

    df = spark.range(3000).select("id", F.col("id").cast("double").alias("v"))
    numbered, block = shuffled_targets(number_rows(df, "id"), "v", 400)
    rows = numbered.select(*block.columns).toPandas()
    tracemalloc.start()
    out = block.make(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(sorted(out[:, j]) == list(range(3000)) for j in (0, 399))
    assert peak < 3 * out.nbytes


def test_values_reach_the_driver_in_stretches(spark, monkeypatch):
    """Not as a row each, which would be many times the vector; missing values stay missing."""
    from pyspark.sql import DataFrame

    given, collected = [], DataFrame.collect
    monkeypatch.setattr(S, "STRETCH", 64)
    monkeypatch.setattr(DataFrame, "toPandas", lambda df: pytest.fail("rows are collected"))
    monkeypatch.setattr(DataFrame, "collect", lambda df: given.append(df.count()) or collected(df))
    df = spark.range(300).select("id", F.when(F.col("id") != 7, F.col("id").cast("double")).alias("v"))
    numbered, block = S.shuffled_targets(S.number_rows(df, "id"), "v", 3)
    monkeypatch.undo()
    assert max(given, default=0) <= 5
    rows = numbered.toPandas()
    at = dict(zip(rows["_slot"], rows["v"]))
    want = np.array([[at[s] for s in S.donors(np.array([slot]), 300, S.round_keys(3))[0]] for slot in rows["_slot"]])
    assert np.array_equal(block.make(rows), want, equal_nan=True) and np.isnan(want).sum() == 3
