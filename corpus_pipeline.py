"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next one.

Counts as part of the subpackage `varve.llm`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm.decontaminate import contamination
from varve.llm.langid import fit_languages, keep_identified
from varve.llm.mixing import mixed_documents
from varve.llm.near_dedup import near_duplicate_groups
from varve.llm.sharding import shard_documents
from varve.llm.tables import may_hold, unused
from varve.session import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; null and empty texts and texts without a letter go.

    The model learns from the rows' own non-null `lang`; where there is none, every text with a letter stays. Repeated rows fare alike.
    """
    return keep_identified(docs, fit_languages(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates (five words, 0.8); null and wordless texts stay.

    Of rows that repeat a kept doc_id and its text one stays; texts that differ under one doc_id are documents of their own.
    """
    found = near_duplicate_groups(docs).groupBy(F.col("doc_id").alias("_kept")).agg(F.count_if("kept").alias("_rows"), F.count_if(~F.col("kept")).alias("_gone"))
    found = stage(found)
    kept = found.where("_rows > 0")
    # Rows whose id has none to drop stay where they are; only the others meet the kept ids.
    (mark,) = unused(docs, "_may")
    marked = may_hold(docs, "doc_id", found.where("_gone > 0").select("_kept"), mark)
    doubtful = marked.where(mark).drop(mark)
    left = marked.where(~F.col(mark)).drop(mark).unionByName(doubtful.join(kept, doubtful.doc_id.eqNullSafe(kept._kept), "left_semi"))
    repeated = stage(kept.where("_rows > 1"))
    if repeated.isEmpty():  # ids are unique, as a rule
        return left
    same = left.doc_id.eqNullSafe(repeated._kept)
    return left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark. The whole document goes, as what surrounds a test item often gives its answer."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_hit = 0").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with `shard` and `slot`."""
    return shard_documents(docs).drop("text_digest")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

#: No SQL: naive Bayes and MinHash have none. tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
