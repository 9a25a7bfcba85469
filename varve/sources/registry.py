"""Run registry: an append-only Parquet table of run metadata."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What is known of a run. `notes` holds any further values by name, each as JSON.
RUN_SCHEMA = (
    "run_id string, run_name string, seed long, timestamp string, git_commit string, config_hash string, "
    "description string, changes_from_last_run string, pearson_r double, pearson_p_emp double, "
    "n_samples long, model_name string, notes map<string,string>"
)

# The fields two runs are compared on.
COMPARED = ["seed", "git_commit", "config_hash", "description", "pearson_r", "pearson_p_emp", "n_samples", "model_name"]


def _leaves(value, path: str = ""):
    """Every (path, type, value) of nested settings; an empty mapping or list is a leaf."""
    if isinstance(value, (dict, list, tuple)) and value:
        for name, inner in value.items() if isinstance(value, dict) else enumerate(value):
            yield from _leaves(inner, f"{path}/{name}")
    else:
        yield f"{path}\t{type(value).__name__}\t{value}"


def config_hash(config: dict) -> str:
    """A short name for a set of settings, whatever the order of their names."""
    digest = hashlib.blake2b(digest_size=8)
    for leaf in sorted(_leaves(config)):
        digest.update(leaf.encode() + b"\n")
    return digest.hexdigest()


def record_run(spark: SparkSession, path: str, run_id: str, run_name: str, config: dict | None = None, notes: dict | None = None, **fields) -> None:
    """Append one run; unknown fields are an error, and belong in `notes`."""
    row = {
        "run_id": run_id,
        "run_name": run_name,
        "seed": 42,
        "timestamp": datetime.now(tz=timezone.utc).isoformat(),
        "config_hash": config_hash(config or {}),
        "notes": {str(k): json.dumps(v, default=str) for k, v in (notes or {}).items()},
        **fields,
    }
    names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
    unknown = set(row) - set(names)
    if unknown:
        raise ValueError(f"unknown run fields: {sorted(unknown)}")
    spark.createDataFrame([tuple(row.get(n) for n in names)], RUN_SCHEMA).write.mode("append").parquet(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs; fields that older files lack are null."""
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def list_runs(runs: DataFrame, run_name: str | None = None) -> DataFrame:
    """Runs, oldest first, optionally of one name."""
    chosen = runs if run_name is None else runs.where(F.col("run_name") == run_name)
    return chosen.orderBy("timestamp", "run_id")


def compare_runs(runs: DataFrame, run_a: str, run_b: str, fields=COMPARED) -> DataFrame:
    """(field, run_a, run_b) where the two runs differ."""

    def tall(run_id, side):
        one = runs.where(F.col("run_id") == run_id).select(*[F.col(f).cast("string").alias(f) for f in fields])
        return one.unpivot([], list(fields), "field", side)

    both = tall(run_a, "run_a").join(tall(run_b, "run_b"), "field", "full")
    return both.where(~F.col("run_a").eqNullSafe(F.col("run_b")))
