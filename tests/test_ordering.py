import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varve.operators import ordering as O
from varve.operators import resample as R
from varve.operators import splits as L
from varve.operators.missing import forward_fill


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one stratum and one value."""
    rng = np.random.default_rng(1)
    n = 1500
    value = np.where(np.arange(n) % 3 == 0, 7.0, rng.normal(0, 5, n).round(2))
    grp = np.where(np.arange(n) % 3 == 0, "hot", rng.choice(list("abc"), n))
    pdf = pd.DataFrame({"id": np.arange(n), "v": value, "g": grp, "fam": np.arange(n) // 3})
    return pdf, spark.createDataFrame(pdf).repartition(8)


def test_parts_have_exact_sizes_and_ignore_partitioning(hot):
    pdf, df = hot
    cut = lambda d: {r["id"]: r["p"] for r in O.hash_parts(d, "id", lambda n: [F.lit(0), F.floor(n / 2)], ["g"], out="p").collect()}
    first = cut(df)
    assert first == cut(df.coalesce(1))
    sizes = pdf.assign(p=pdf.id.map(first)).groupby(["g", "p"]).size()
    for g, n in pdf.groupby("g").size().items():
        assert sizes[g, 1] == n // 2 and sizes[g, 2] == n - n // 2


def test_rank_is_a_permutation(hot):
    pdf, df = hot
    out = O.hash_rank(df, "id", ["g"]).toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))


def test_quantiles_match_numpy(hot):
    pdf, df = hot
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.975, 1.0]
    got = O.order_stats(df, "v", probs, ["g"]).toPandas()
    assert len(got) == len(probs) * pdf.g.nunique()
    for r in got.itertuples():
        assert r.value == pytest.approx(np.quantile(pdf.v[pdf.g == r.g], r.prob), abs=1e-12)


def test_average_ranks_match_pandas(hot):
    pdf, df = hot
    got = O.average_ranks(df, "v").toPandas().set_index("v")["rank"]
    want = pdf.v.rank()
    assert (pdf.v.map(got) - want).abs().max() == 0


def test_families_never_split(hot, spark):
    pdf, df = hot
    solo = df.withColumn("fam", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("fam")))
    out = L.assign_group_folds(solo, "fam", "id", "g", 5)
    assert out.count() == len(pdf)
    assert L.leaked_families(out, "fam", "fold").first()["leaked"] == 0
    sizes = out.groupBy("fold").count().toPandas()["count"]
    assert len(sizes) == 5 and sizes.min() > 0.7 * len(pdf) / 5


def test_stratification_falls_back(spark):
    df = spark.createDataFrame([(i, i % 2, "a" if i < 18 else "b") for i in range(20)], "id int, b int, s string")
    assert L.stratification_key(df, "b", "s", 1)[1] == "bin_site"
    assert L.stratification_key(df, "b", "s", 2)[1] == "site"
    assert L.stratification_key(df, "b", "s", 5)[1] == "bin"


def test_balance_and_halves(hot):
    pdf, df = hot
    out = L.balance_classes(df, "id", "g").groupBy("g").count().toPandas()["count"]
    assert set(out) == {pdf.groupby("g").size().min()}
    halves = L.random_halves(df, "fam", 2).groupBy("iteration", "half").count().toPandas()
    assert set(halves["count"]) == {pdf.fam.nunique() // 2}


def test_bootstrap_and_permutation_keep_totals(hot):
    pdf, df = hot
    exact = R.bootstrap_exact(df, "id", 3).groupBy("b").agg(F.sum("w").alias("n")).toPandas()
    assert set(exact.n) == {len(pdf)}
    loose = R.poisson_weights(df, "id", 8).groupBy("b").agg(F.sum("w").alias("n")).toPandas()
    assert len(loose) == 8 and (loose.n - len(pdf)).abs().max() < 5 * len(pdf) ** 0.5
    perm = R.permute(df, "id", "v", 2).toPandas()
    for _, part in perm.groupby("perm"):
        assert sorted(part.permuted) == sorted(pdf.v)


def test_bucketed_fill_equals_plain_fill(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": rng.integers(0, 3, 200), "t": np.arange(200), "x": np.where(rng.random(200) < 0.6, np.nan, np.arange(200.0))})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    plain = {r["t"]: r["x"] for r in forward_fill(df, "id", "t", ["x"]).collect()}
    bucketed = {r["t"]: r["x"] for r in forward_fill(df, "id", "t", ["x"], F.floor(F.col("t") / 17)).collect()}
    assert plain == bucketed
