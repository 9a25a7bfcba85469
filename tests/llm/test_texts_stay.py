"""Texts of which nothing is dropped are not shuffled to drop others."""

from pyspark.sql import functions as F

import corpus_pipeline as C
from varve.llm.tables import may_hold
from varve.session import stage


def test_bitmap_misses_no_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") == 7, None).otherwise(F.col("id") * 3).alias("key"), F.lit("x").alias("_word"))
    some = df.where("key % 9 = 0 or key is null").select(F.col("key").alias("other"))
    got = may_hold(df, "key", some, "may").toPandas()
    assert len(got) == 20_000 and list(got.columns) == ["key", "_word", "may"]
    true = got.key.isna() | (got.key % 9 == 0)
    assert got.may[true].all() and got.may[~true].mean() < 0.01
    assert not may_hold(df, "key", some.limit(0), "may").where("may").count()


def test_kept_texts_are_not_shuffled(spark):
    words = lambda i: " ".join(f"w{(i * 7919 + j * j) % 100_003}" for j in range(30))
    rows = [(i, words(i)) for i in reversed(range(300))] + [(1000 + i, words(i) + (" more" if i % 2 else "")) for i in range(20)]
    rows += [(None, "alone here"), (2000, None), (2001, "twice the same text"), (2001, "twice the same text")]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = [r.doc_id for r in C.near_dedup(spark, docs.where("doc_id is null or doc_id <> 2001"), None).collect()]
        assert sorted(-1 if i is None else i for i in out) == [-1, *range(300), 2000]
        assert [i for i in out[:270] if i is not None and i < 300] == sorted((i for i in out[:270] if i is not None and i < 300), reverse=True)  # as in the file, which a shuffle would not leave
        out = C.near_dedup(spark, docs, None).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id) for r in out) == [-1, *range(300), 2000, 2001]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
