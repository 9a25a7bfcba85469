"""Permutations as rows: what Spark may broadcast."""

from pyspark.sql import functions as F

from varve.operators.resample import permute


def test_multiplied_rows_are_never_broadcast(spark):
    df = spark.range(2000).select("id", (F.col("id") * 3 % 101).alias("v"), (F.col("id") % 7).alias("x"))
    out = permute(df, "id", "v", 5, keep=["x"])
    # On an estimate of the rows before they are multiplied, every side here is small enough to be broadcast.
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
    pdf = out.toPandas()
    assert len(pdf) == 10_000 and (pdf["x"] == pdf["id"] % 7).all()
    for _, one in pdf.groupby("perm"):
        assert sorted(one["permuted"]) == sorted(i * 3 % 101 for i in range(2000))
