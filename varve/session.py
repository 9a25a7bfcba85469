"""Session helpers and the staging area for small multi-use tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def get_session(app: str = "varve", **conf) -> SparkSession:
    """A session with the settings the operators assume; callers may override any of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Folder for staged tables: the shared `spark.checkpoint.dir` of the session.

    Only a local master may fall back to a folder of its own; on a cluster a machine-local folder would
    be invisible to the other executors, so the setting is then required.
    """
    global _local_root
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/varve-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="varve-")
    return _local_root


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts lineage, survives executor loss, and gives Spark the exact file size, so a later join broadcasts
    the table only when it is below `spark.sql.autoBroadcastJoinThreshold` and shuffles it otherwise.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, keys) -> DataFrame:
    """Rows in two parts per core, each ordered by `keys`, for a table that many heavy passes read.

    A narrow table is few bytes and would be read by as few tasks, whatever a row costs there; in order, a batch holds few groups.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions(*keys)


def stage_small(df: DataFrame) -> DataFrame:
    """`stage` for aggregate results: one output file instead of one per shuffle partition."""
    return stage(df.coalesce(1))
