"""Scores of linear studies from sums per fold and site, beside those from a row per run and group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varve.models import regression as R
from varve.operators.splits import random_halves, random_member
from varve.plans import robustness as B
from varve.plans.catalog_models import baseline_rows, spec

DATA = "/root/testdata/sf0.001"


def same(got, want, keys):
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and len(a)
    for c in ("pearson_r", "r2", "mse", "n"):
        if c in b:
            np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("groups, over", [([], {}), (["sex"], {"covariates": ("age",), "residualize": ("age",)}), ([], {"residualize": (), "eb": False}), ([], {"harmonize": False})])
def test_scores_from_sums_are_those_from_rows(spark, groups, over):
    one = spec(**over)
    prepared = R.prepare(baseline_rows(spark, DATA), one, keep=groups)
    for model in ("ridge", "elastic_net"):
        same(R.fold_scores(prepared, model, groups), R.pooled(prepared, prepared.frame(groups), model, groups), groups or ["model"])


def test_sets_of_rows_are_those_of_the_splits(spark):
    """Halves and members made within tasks, with families that end a batch, are large, or null."""
    df = spark.range(0, 3000, numPartitions=3).select(
        "id", F.when(F.col("id") % 50 == 1, None).when(F.col("id") % 2 == 0, F.lit(-5)).otherwise(F.floor(F.col("id") / 6)).alias("family"), F.lit(0).alias("fold"), F.lit(1.0).alias("y")
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        for make, want, fits in (
            (lambda: B.halves_of(df, "family", 7, 42), random_halves(df, "family", 7).where("half = 'a'").join(df, "family").select("iteration", "id"), 14),
            (lambda: B.members_of(df, "family", "id", 7, 42), random_member(df.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(6)))), "family", "id", F.col("it")), 7),
        ):
            rows, deal, _ = make()

            def each(batches, deal=deal, fits=fits):
                for part, member in deal(batches):
                    assert member.shape[1] == fits
                    at, it = np.nonzero(member[:, :7])
                    yield pd.DataFrame({"iteration": it, "id": part["id"].to_numpy()[at]})

            got = rows.mapInPandas(each, "iteration int, id long").toPandas()
            want = want.select(F.col("iteration").cast("int"), "id").toPandas()
            assert sorted(map(tuple, got.values)) == sorted(map(tuple, want.values))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_pass_serves_all_halves_and_members(spark, monkeypatch):
    """Neither study makes a row per iteration and run."""
    monkeypatch.setattr(R.Prepared, "frame", lambda *a, **k: pytest.fail("rows were multiplied"))
    rows = baseline_rows(spark, DATA)
    assert B.split_halves(rows, spec(), 3)[0].count() == 3
    assert B.one_per_family(rows, spec(), 3)[0].count() == 3
