"""The pipeline's stages, each judged on its own input, and the registered queries without SQL."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from varve.llm.catalog import Q
from varve.llm.near_dedup import near_duplicate_groups
from varve.session import stage

SF = "/root/testdata/sf0.001"


def test_stages_decide_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    docs = docs.unionByName(spark.createDataFrame([(-1, None, None, None, 0), (-2, "%% 12 !!", "en", "src1", 8)], docs.schema))
    out = {}
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs, stage(function(spark, docs, SF))
        out[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == columns
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    gone = lambda name: ids(out[name][0]) - ids(out[name][1])
    assert set(gone("language_id")) == {-1, -2}
    groups = {r.doc_id: r.component_id for r in near_duplicate_groups(out["near_dedup"][0]).collect()}
    assert set(gone("near_dedup")) == {d for d, c in groups.items() if d != c}
    assert out["decontamination"][0].count() >= out["decontamination"][1].count() > 0
    mixed = out["source_mixing"][1]
    assert set(ids(mixed)) <= set(ids(out["source_mixing"][0])) and max(ids(mixed).values()) <= 3
    assert ids(out["sharding"][1]) == ids(mixed) and {"shard", "slot"} <= set(docs.columns)


def test_stages_on_repeated_rows_and_without_languages(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, None), (1, text, None), (2, text, None), (3, "other words here", None), (3, "quite another text", None), (None, text + " end", None), (4, "%% 12", None), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "_kept": F.lit("x"), "_rows": F.lit("y")})
    left = stage(corpus_pipeline.language_id(spark, docs, SF))
    assert Counter(r.doc_id for r in left.collect()) == {1: 2, 2: 1, 3: 2, None: 1}
    kept = corpus_pipeline.near_dedup(spark, left.drop("_kept", "_rows"), SF)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == {(1, text): 1, (3, "other words here"): 1, (3, "quite another text"): 1}


def test_queries_answer_every_row(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_language_id", "op8_sharding", "op9_license_scan"):
        assert Q[name](spark, SF).count() == n
    assert Q["op6_main_text"](spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()
