import math

import pytest
from pyspark.sql import functions as F

from varve import roles
from varve.functions import pvalues as P
from varve.functions import scalars as S


def test_tails_against_closed_forms():
    assert P.t_two_sided(1.7, 1) == pytest.approx(1 - 2 / math.pi * math.atan(1.7), rel=1e-10)
    assert P.t_two_sided(2.0, 2) == pytest.approx(1 - 2 / math.sqrt(2 + 4), rel=1e-10)
    assert P.f_upper(4.0, 2, 10) == pytest.approx((1 + 2 * 4 / 10) ** -5, rel=1e-10)
    assert P.chi2_upper(3.0, 2) == pytest.approx(math.exp(-1.5), rel=1e-10)
    assert P.chi2_upper(3.84, 1) == pytest.approx(P.normal_two_sided(math.sqrt(3.84)), rel=1e-9)
    assert P.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert P.f_upper(P.f_quantile(0.975, 3, 17), 3, 17) == pytest.approx(0.025, abs=1e-9)


def test_pairs_names_and_columns():
    pairs, rest = roles.bilateral_pairs(["vol_caudatelh", "vol_caudaterh", "scs_aal", "scs_aar", "dtifa_cstl", "dtifa_cstr", "stem"])
    assert pairs == [
        ("caudate", "vol_caudatelh", "vol_caudaterh"), ("accumbens", "scs_aal", "scs_aar"), ("cst_FA", "dtifa_cstl", "dtifa_cstr"),
    ]
    assert rest == ["stem"]
    assert roles.file_columns("imaging", [], [], []) is None
    assert roles.file_columns("metadata", ["a", "b"], ["b"], ["c", "a"]) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        roles.file_columns("other", [], [], [])
    with pytest.raises(ValueError):
        roles.adapt(roles.Settings(), "nothing")
    assert roles.adapt(roles.Settings(), "psychosis").roles.group == "psych_group"
    assert roles.feature_names("ai_total", 4, pairs=[("b", "", ""), ("a", "", "")]) == ["a_AI", "b_AI", "a_total", "b_total"]
    assert roles.prefixed(["dmri_1", "x", "dmri_2"], ["dmri"]) == ["dmri_1", "dmri_2"]


def test_recode_bins_and_extremes(spark):
    df = spark.createDataFrame([(1, 54.0), (2, 54.5), (3, 70.0), (9, None)], "code long, score double")
    out = df.select(
        S.value_map(F.col("code"), {1: "male", "2": "female"}).alias("m"),
        S.right_closed_bin(F.col("score"), (54, 69), ("Control", "Subclinical", "Clinical")).alias("b"),
        S.extreme_group(F.col("score"), 54, 70).alias("e"),
    ).collect()
    assert [tuple(r) for r in out] == [("male", "Control", "Low"), ("female", "Subclinical", None), (None, "Clinical", "High"), (None, None, None)]


def test_asymmetry_guard(spark):
    df = spark.createDataFrame([(3.0, 1.0), (1.0, -1.0), (None, 1.0)], "l double, r double")
    assert [r[0] for r in df.select(S.asymmetry(F.col("l"), F.col("r"))).collect()] == [0.5, None, None]


def test_whole_doubles_are_looked_up_like_integers(spark):
    df = spark.createDataFrame([(1.0, "1"), (2.0, "2.0"), (1.5, None), (None, "3")], "a double, b string")
    got = df.select(S.value_map(F.col("a"), {1: "m", 2.0: "f", 1.5: "x"}).alias("a"), S.value_map(F.col("b"), {"1": "m", "2.0": "f"}).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("m", "m"), ("f", "f"), ("x", None), (None, None)]


def test_every_question_adapts():
    base = roles.Settings()
    for name in ("anxiety", "psychosis", "comorbidity", "regression"):
        required = roles.adapt(base, name).required
        assert "t_score" in required and ("research_group" in required) == (name != "regression")
    assert roles.adapt(base, "comorbidity").roles.group == "comorbid_group"


def test_a_missing_follow_up_age_is_not_replaced(spark):
    from varve.operators.prep import backfill_from_baseline

    df = spark.createDataFrame([(1, 0, 9.0, 9.0, "f"), (1, 2, 9.0, None, None), (1, 3, 9.0, 12.0, None)], "id int, visit int, age double, age_long double, sex string")
    got = backfill_from_baseline(df, "id", "visit", 0, {"age": "age_long"}, ["sex"]).orderBy("visit").collect()
    assert [(r.age, r.sex) for r in got] == [(9.0, "f"), (None, "f"), (12.0, "f")]
