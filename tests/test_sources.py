import pytest
from pyspark.sql import functions as F

from varve.operators import prep
from varve.roles import Settings
from varve.operators import missing as M
from varve.sources import readers, registry, sinks


def test_csv_dictionary_strips_byte_order_mark(spark, tmp_path):
    path = tmp_path / "dict.csv"
    path.write_bytes("﻿var_name,var_label\nx1,First\n".encode("utf-8"))
    assert [tuple(r) for r in readers.read_dictionary(spark, str(path)).collect()] == [("x1", "First")]


def test_merge_counts_null_keys_and_refuses_collisions(spark):
    a = spark.createDataFrame([(1, "b", 1.0), (None, "b", 2.0)], "id int, v string, x double")
    b = spark.createDataFrame([(1, 3.0), (2, 4.0)], "id int, y double")
    out = readers.merge_all([a, b], ["id", "v"], "b").orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, "b", 1.0, 3.0), (2, "b", None, 4.0)]
    assert readers.null_key_counts([a], ["id"])[0].first()[0] == 1
    with pytest.raises(ValueError):
        readers.merge_all([a, a], ["id", "v"], "b")


def test_merge_filters_visits_at_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "b", 1.0), (1, "f", 2.0)], "id int, v string, x double").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = readers.merge_all([t, t.withColumnRenamed("x", "z")], ["id", "v"], "b", visits=["b"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: []" not in plan and "EqualTo(v,b)" in plan or "In(v" in plan


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert [r[0] for r in readers.nulls_for_nan(df).collect()] == [None, None, 1.0]


def test_registry_roundtrip(spark, tmp_path):
    path = str(tmp_path / "runs")
    registry.record_run(spark, path, "r1", "anx", seed=1, pearson_r=0.1, timestamp="2024-01-01")
    registry.record_run(spark, path, "r2", "anx", seed=2, pearson_r=0.1, timestamp="2024-01-02")
    runs = registry.load_runs(spark, path)
    assert [r["run_id"] for r in registry.list_runs(runs, "anx").collect()] == ["r1", "r2"]
    assert [tuple(r) for r in registry.compare_runs(runs, "r1", "r2").collect()] == [("seed", "1", "2")]
    with pytest.raises(ValueError):
        registry.record_run(spark, path, "r3", "anx", nonsense=1)


def test_runs_carry_notes_and_settings_have_a_name(spark, tmp_path):
    path = str(tmp_path / "noted")
    registry.record_run(spark, path, "r1", "anx", {"a": {"b": [1, 2], "c": None}}, notes={"why": "trial", "limits": [1, 2]})
    registry.record_run(spark, path, "r2", "anx", {"a": {"c": None, "b": [1, 2]}})
    rows = {r["run_id"]: r for r in registry.load_runs(spark, path).collect()}
    assert rows["r1"]["notes"] == {"why": '"trial"', "limits": "[1, 2]"} and rows["r2"]["notes"] == {}
    assert rows["r1"]["config_hash"] == rows["r2"]["config_hash"]
    other = [registry.config_hash(c) for c in ({}, {"a": 1}, {"a": "1"}, {"a": [1]}, {"a": {"b": 1}}, {"a": []})]
    assert len(set(other)) == len(other)


def test_sinks_write_parquet_and_csv(spark, tmp_path):
    folder = sinks.run_path(str(tmp_path), "anx", "r1", 42, "datasets")
    sinks.save_tables(folder, include_csv=True, t=spark.range(5).toDF("x"))
    assert folder.endswith("anx/r1/seed_42/datasets")
    assert spark.read.parquet(f"{folder}/t.parquet").count() == 5
    assert readers.read_csv(spark, f"{folder}/t.csv").agg(F.sum("x")).first()[0] == 10


def test_quality_control_edges(spark):
    df = spark.createDataFrame([(1, 62), (2, 63), (3, None)], "id int, q int")
    rows = {r["id"]: (r["qc_pass"], r["qc_reason"]) for r in prep.quality_control(df, ["id"], "q", 62)[1].collect()}
    assert rows == {1: (True, None), 2: (False, "surface_holes_gt_threshold"), 3: (False, "missing_surface_holes")}
    with pytest.raises(KeyError):
        prep.quality_control(df, ["id"], "absent", 62)


def test_handle_missing_order(spark):
    rows = [(i, 1.0 if i else None, 1.0 if i > 3 else None, 1.0 if i != 5 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, meta double, sparse double, dense double")
    kept, dropped = M.handle_missing(df, Settings(required=("meta",), max_null_rate=0.3), protected=["id", "meta"])
    assert dropped == ["sparse"] and sorted(r["id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 9]
