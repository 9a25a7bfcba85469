"""Bootstrap sums and areas from weight matrices against one row per draw."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varve.operators import bootstrap as B
from varve.operators import evaluation as V
from varve.operators.resample import poisson_weights


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    n = 400
    s = rng.normal(size=n).round(2)
    s[rng.random(n) < 0.35] = 0.5  # a third of all rows share one score
    pdf = pd.DataFrame({"id": np.arange(n), "part": rng.choice(["u", "v", None], n), "s": s, "y": (s + rng.normal(size=n) > 0.4).astype(int), "x": rng.normal(size=n)})
    df = spark.createDataFrame(pdf)
    return df.withColumns({"y": F.when(F.col("id") != 7, F.col("y")), "s": F.when(F.col("id") != 9, F.col("s"))})


def test_sums_equal_weighted_rows(scored, monkeypatch):
    stats = {"n": F.lit(1.0), "x": F.col("x"), "xs": F.col("x") * F.col("s")}  # a null adds nothing
    weighted = poisson_weights(scored, ["id", "part"], 10, 5, "t").groupBy("b").agg(*[F.sum(F.col("w") * e).alias(n) for n, e in stats.items()])
    want = weighted.toPandas().sort_values("b")[list(stats)].to_numpy(float)
    for kept, cells in ((16_000_000, 2_000_000), (17, 50)):  # also with blocks of draws and slices of rows
        monkeypatch.setattr(B, "KEPT_CELLS", kept)
        got = B.draw_sums(scored, ["id", "part"], stats, 10, 5, "t").toPandas().sort_values("b")
        assert got.b.tolist() == list(range(10)) and np.allclose(got[list(stats)].to_numpy(), want)


def test_draws_without_rows_are_absent(spark):
    one = spark.createDataFrame([(1, 2.0)], "id long, x double")
    drawn = {r.b: r.w for r in poisson_weights(one, "id", 40).collect()}
    assert {r.b: r.x for r in B.draw_sums(one, "id", {"x": F.col("x")}, 40).collect()} == {b: 2.0 * w for b, w in drawn.items()}
    assert B.draw_sums(one.limit(0), "id", {"x": F.col("x")}, 8).count() == 0


def test_areas_equal_weighted_areas(scored):
    got = B.draw_auc(scored, "id", "y", "s", 12).toPandas().set_index("b").auc
    weighted = poisson_weights(scored.select("id", "y", "s"), "id", 12)
    want = V.roc_auc(weighted, "y", "s", ["b"], "w").toPandas().set_index("b").auc
    assert len(got) == 12 and np.allclose(got.sort_index(), want.sort_index())
    one_class = B.draw_auc(scored.where("y = 1"), "id", "y", "s", 4).toPandas().auc
    assert one_class.isna().all() and B.draw_auc(scored.limit(0), "id", "y", "s", 4).count() == 0


def test_weights_follow_poisson():
    w = B.weight_matrix([f"|{i}" for i in range(50)], range(0, 4000))
    freq = np.bincount(w.ravel(), minlength=6)[:6] / w.size
    assert np.allclose(freq, [np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120)], atol=0.004)
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.06


def test_weights_of_keys_of_all_lengths_are_those_of_their_md5_and_much_cheaper():
    import time
    from hashlib import md5

    import numpy as np

    from varve.operators.bootstrap import _STEPS, weight_matrix

    def one_by_one(keys, draws):
        digests = b"".join(md5(f"42|boot|{k}".encode() + key.encode()).digest() for key in keys for k in range(draws.start // 4, draws.stop // 4))
        u = np.frombuffer(digests, ">u4").astype(np.uint32)
        return sum((u >= s).astype(int) for s in _STEPS).reshape(len(keys), len(draws))

    mixed = ["", "|1", "|20", "|é|x", "|300", *["|" + "y" * n for n in range(42, 50)], "|" + "z" * 70]
    for draws in (range(0, 40), range(36, 4400)):
        assert (weight_matrix(mixed, draws) == one_by_one(mixed, draws)).all()
    assert weight_matrix([], range(0, 8)).shape == (0, 8)
    keys, took = [f"|{i}" for i in range(100_000, 100_040)], []
    for make in (weight_matrix, one_by_one):
        best = float("inf")
        for _ in range(3):
            start = time.process_time()
            make(keys, range(0, 10_000))
            best = min(best, time.process_time() - start)
        took.append(best)
    assert took[0] < took[1] / 2
