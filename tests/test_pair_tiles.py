"""Pair statistics from tiles against pandas and least squares."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varve.operators import association as A
from varve.operators import pair_tiles as P


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(120, 5)) + 1000, columns=list("abcde"))
    pdf["e"], pdf["y"] = 3.5, pdf.a - 1000 + (pdf.b - 1000) * (pdf.c - 1000) + rng.normal(size=120)
    pdf = pdf.mask(rng.random(pdf.shape) < 0.1).assign(g=rng.choice(["u", "v"], 120), near=0.0)
    pdf.loc[:1, "near"] = [1.0, 2.0]
    df = spark.createDataFrame(pdf)
    return pdf, df.select("g", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in [*"abcde", "y", "near"]])


@pytest.mark.parametrize("tile", [64, 2])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_correlations(table, groups, tile, monkeypatch):
    monkeypatch.setattr(P, "TILE", tile)
    pdf, df = table
    got = A.correlation_matrix(df, list("abe"), ["c", "y"], groups).toPandas()
    pairs = A.pairwise_correlations(df, list("dcabe"), groups).toPandas()
    assert len(got) == 6 * (2 if groups else 1) and len(pairs) == 10 * (2 if groups else 1) and (pairs.a < pairs.b).all()
    for out in (got, pairs):
        for r in out.itertuples():
            part = (pdf if not groups else pdf[pdf.g == r.g])[[r.a, r.b]].dropna()
            assert r.n == len(part)
            want = part[r.a].corr(part[r.b]) if "e" not in (r.a, r.b) else None
            assert np.isnan(r.r) if want is None else r.r == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("tile", [64, 2])
def test_interactions(table, tile, monkeypatch):
    monkeypatch.setattr(P, "TILE", tile)
    pdf, df = table
    got = A.pair_interactions(df, list("cabe"), "y").toPandas()
    assert len(got) == 6 and (got.feature_a < got.feature_b).all()
    known = got.dropna(subset=["t"])
    assert sorted(known.feature_a + known.feature_b) == ["ab", "ac", "bc"] and got.dropna(subset=["p_fdr"]).p_fdr.between(0, 1).all()
    for r in known.itertuples():
        part = pdf[[r.feature_a, r.feature_b, "y"]].dropna().to_numpy() - [1000, 1000, 0]
        a, b, y = part.T
        x = np.column_stack([np.ones(len(y)), a, b, a * b])
        beta, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
        se = np.sqrt(rss[0] / (len(y) - 4) * np.linalg.inv(x.T @ x)[3, 3])
        assert (r.n, r.beta_interaction, r.t, r.r2) == (len(y), pytest.approx(beta[3], abs=1e-6), pytest.approx(beta[3] / se, rel=1e-5), pytest.approx(1 - rss[0] / y.var() / len(y)))


def test_empty_table_and_few_rows(table):
    _, df = table
    assert A.pairwise_correlations(df.limit(0), list("abc")).count() == 0
    one = A.pairwise_correlations(df.where("a is not null and b is not null").limit(1), ["a", "b"]).first()
    assert one["r"] is None and one["n"] == 1


def test_a_thousand_features(spark):
    """Half a million pairs of a thousand columns: no row is copied for a pair."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 1000))
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i:04d}" for i in range(1000)])).repartition(4)
    got = A.pairwise_correlations(df, df.columns).toPandas()
    want = np.corrcoef(x.T)
    assert len(got) == 499_500
    i, j = got.a.str[1:].astype(int), got.b.str[1:].astype(int)
    assert np.abs(got.r.to_numpy() - want[i, j]).max() < 1e-9
