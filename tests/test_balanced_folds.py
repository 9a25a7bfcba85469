"""Folds of whole families against dealing them one after the other."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varve.operators import splits as S


def people(seed, families, strata, hot=0):
    """Families of one to six, most of one stratum and some mixed; one of `hot` rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(families):
        home = rng.choice(strata, p=np.arange(1, strata + 1) / (strata * (strata + 1) / 2))
        for _ in range(rng.integers(1, 7)):
            rows.append((f"f{f}", f"s{home if rng.random() < 0.7 else rng.integers(strata)}"))
    rows += [("big", f"s{i % strata}") for i in range(hot)]
    return pd.DataFrame(rows, columns=["fam", "st"]).assign(id=lambda d: np.arange(len(d)), extra=1.5)


def one_after_the_other(pdf, k):
    """The sequential rule: families of the most uneven counts first, each where class shares then vary least over folds."""
    table = pd.crosstab(pdf.fam, pdf.st)
    counts, totals, held = table.to_numpy(float), table.to_numpy(float).sum(0), np.zeros((k, table.shape[1]))
    for i in np.argsort(-counts.std(axis=1), kind="stable"):
        tried = []
        for f in range(k):
            held[f] += counts[i]
            tried.append(((held / totals).std(axis=0).mean(), held[f].sum()))
            held[f] -= counts[i]
        held[min(range(k), key=lambda f: tried[f])] += counts[i]
    return (held / totals).std(axis=0).mean()


def shares_of(out, k):
    table = pd.crosstab(out.fold, out.st).reindex(range(k), fill_value=0).to_numpy(float)
    return (table / table.sum(0)).std(axis=0).mean()


@pytest.mark.parametrize("seed,families,strata,hot", [(0, 400, 4, 0), (1, 1200, 3, 0), (2, 300, 6, 60)])
def test_shares_are_no_more_uneven_than_by_the_sequential_rule(spark, seed, families, strata, hot):
    pdf = people(seed, families, strata, hot)
    out = S.balanced_group_folds(spark.createDataFrame(pdf).repartition(4), "fam", "id", "st").toPandas()
    assert sorted(out.id) == list(range(len(pdf))) and list(out.columns) == [*pdf.columns, "fold"]
    assert out.groupby("fam").fold.nunique().max() == 1 and set(out.fold) == set(range(5))
    assert shares_of(out, 5) <= max(one_after_the_other(pdf, 5), 0.002)


def test_levels_of_piles_keep_the_balance(spark, monkeypatch):
    pdf = people(5, 500, 4)
    df = spark.createDataFrame(pdf)
    monkeypatch.setattr(S, "DEALT", 40)
    out = S.balanced_group_folds(df, "fam", "id", "st", 5).toPandas()
    assert sorted(out.id) == list(range(len(pdf))) and out.groupby("fam").fold.nunique().max() == 1
    assert shares_of(out, 5) < 0.01
    again = S.balanced_group_folds(df.repartition(7), "fam", "id", "st", 5).toPandas()
    assert dict(zip(out.id, out.fold)) == dict(zip(again.id, again.fold))


def test_nulls_old_column_and_empty_table(spark):
    df = spark.createDataFrame([(i, None if i < 30 else "1", None if i % 2 else "a", 9) for i in range(40)], "id int, fam string, st string, fold int")
    out = S.balanced_group_folds(df, "fam", "id", "st", 3)
    rows = out.toPandas()
    assert len(rows) == 40 and out.columns == ["id", "fam", "st", "fold"] and rows[rows.fam == "1"].fold.nunique() == 1
    spread = {r["st"]: r for r in S.class_spread(out, "fold", "st", 3).collect()}
    assert spread["a"]["most"] - spread["a"]["least"] <= 2 and spread[None]["n"] == 20
    assert S.balanced_group_folds(df.where("id < 0"), "fam", "id", "st").count() == 0
