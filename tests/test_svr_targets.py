"""Support vector regressions of many targets over the same rows, against one fit for each."""

import numpy as np
import pandas as pd
import pytest

from varve.models import regression as R
from varve.models import svr_targets as M
from varve.operators import shuffles as S
from varve.plans import catalog_models
from varve.session import stage


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(11)
    n = 900
    pdf = pd.DataFrame(rng.normal(size=(n, 2)), columns=["a", "b"]).assign(id=np.arange(n), site=[f"s{i % 2}" for i in range(n)], age=rng.normal(size=n))
    pdf["y"] = 0.4 * pdf.a + 0.3 * pdf.age + rng.standard_t(5, size=n)
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("limits, resid", [({}, ()), ({"NEAR": 60, "START_ROWS": 150, "WITHIN": 80}, ("age",)), ({"NEAR": 2, "_MOST_CENTRES": 1}, ("age",))])
def test_scores_of_permuted_targets_equal_refitting_each(spark, cohort, limits, resid, monkeypatch):
    """Also when the fits end over few rows and start from some, and when passes over all rows must end them."""
    for name, value in limits.items():
        monkeypatch.setattr(M, name, value)
    spec = R.Spec("id", "y", ("a", "b"), "site", ("age",), resid, folds=3)
    null, p = R.permutation_null(cohort, spec, 6, "svr")
    null = null.toPandas().set_index("draw").pearson_r
    prepared = R.prepare(cohort, spec)
    numbered, block = S.shuffled_targets(S.number_rows(prepared.rows, "id"), "y", 6)
    rows = numbered.toPandas()
    given = block.make(rows)
    for j in (5,):
        moved = R.Prepared(spark.createDataFrame(rows[list(prepared.rows.columns)].assign(y=given[:, j])), spec, prepared.harm, prepared.resid)
        assert null[f"perm{j}"] == pytest.approx(R.pooled(moved, stage(moved.frame()), "svr").first()["pearson_r"], abs=2e-4)
    seen = p.first()
    assert len(null) == 6 and seen["observed"] == pytest.approx(R.pooled(prepared, stage(prepared.frame()), "svr").first()["pearson_r"], abs=2e-4)
    assert seen["p"] == pytest.approx((1 + (null.abs() >= abs(seen["observed"])).sum()) / 7)


def test_svr_study_permutes_as_often_as_the_linear_one(monkeypatch):
    asked = {}
    monkeypatch.setattr(R, "permutation_null", lambda rows, spec, perms, model="ridge", **more: (asked.__setitem__(model, perms), None))
    monkeypatch.setattr(catalog_models, "baseline_rows", lambda spark, d: None)
    catalog_models.m18(None, "")
    catalog_models.m18b(None, "")
    assert asked == {"ridge": 1000, "svr": 1000}


def test_shuffles_within_groups(cohort):
    """Targets of the support vector study stay within their group, as those of the linear one do."""
    from pyspark.sql import functions as F

    df = cohort.withColumns({"g": (F.col("id") % 2).cast("string"), "y": F.col("y") + 100 * (F.col("id") % 2)})
    spec = R.Spec("id", "y", ("a", "b"), "site", ("age",), ("age",), folds=3)
    null, p = R.permutation_null(df, spec, 4, "svr", groups=["g"])
    assert null.groupBy("g").count().toPandas()["count"].tolist() == [4, 4] and p.count() == 2
    assert null.toPandas().pearson_r.abs().max() < 0.3


def test_some_donors_and_none():
    keys = S.round_keys(5)
    slots = np.arange(40)
    assert (S.donors(slots, 40, keys[:, [3, 1]]) == S.donors(slots, 40, keys)[:, [3, 1]]).all()
    assert S.donors(slots, 40, keys[:, []]).shape == (40, 0)
