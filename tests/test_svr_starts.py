"""Support vector fits that start from some of the rows, and leaving each feature out without copying rows."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varve.models import regression as R
from varve.models import svr
from varve.models.svr import Fit, Variant, fit_svr_variants
from varve.plans import robustness as B
from varve.plans.catalog_models import baseline_rows, spec
from varve.session import stage


def test_svr_starts_from_some_rows_and_ends_over_all(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 60_000
    x = rng.normal(size=(n, 3))
    t = 0.3 * x[:, 0] - 0.1 * x[:, 1] + rng.standard_t(5, n)
    df = stage(spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(t=t, k=np.arange(n) % 2)))
    variants = [Variant(f"{C}|{blank}", C, 0.1, blank=blank) for C in (0.001, 1.0) for blank in (None, 1)]
    passes, step = Counter(), Fit.advance

    def counted(fit, sums):
        if fit.searching or sums[-1] == n / 2:
            passes[id(fit)] += 1
        step(fit, sums)

    monkeypatch.setattr(svr, "START_ROWS", 2_000)
    monkeypatch.setattr(Fit, "advance", counted)
    found = fit_svr_variants(df, list("abc"), "t", ["k"], lambda key: variants)
    monkeypatch.undo()
    assert len(found) == 8 and max(passes.values()) <= 8
    for k in (0, 1):
        mine = np.column_stack([np.ones(n // 2), x[np.arange(n) % 2 == k]])
        for v in variants:
            rows, of_k = mine.copy(), t[np.arange(n) % 2 == k]
            rows[:, 1] *= 0.0 if v.blank else 1.0
            fit = Fit(np.concatenate([[of_k.mean()], np.zeros(3)]), of_k.std() / v.C, v.C, 1e-5, 0.1, of_k.std())
            while not fit.done:
                fit.advance(fit.sums(rows, of_k))
            assert np.allclose(found[(k,), v.name], fit.b, atol=1e-4)


def test_leaving_each_feature_out_copies_no_rows(spark, monkeypatch):
    rows, given = baseline_rows(spark, "/root/testdata/sf0.001"), []
    prepared = R.prepare(rows, spec())
    frame = stage(prepared.frame())
    names = prepared.spec.inputs
    want = [R.pooled(prepared, frame.withColumns({n: F.lit(0.0)}) if n else frame, "svr").first()["pearson_r"] for n in [None, *names]]
    fit = R.fit_svr_variants
    monkeypatch.setattr(R, "fit_svr_variants", lambda train, *a, **k: (given.append(train.count()), fit(train, *a, **k))[1])
    got = {r["feature"]: (r["r_without"], r["delta_r"]) for r in B.leave_one_out(rows, spec(), "svr").collect()}
    assert given == [prepared.rows.count() * (spec().folds - 1)]
    for n, r in zip(names, want[1:]):
        assert got[n] == pytest.approx((r, want[0] - r), abs=1e-3)
