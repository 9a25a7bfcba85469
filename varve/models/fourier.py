"""Random Fourier features (Rahimi and Recht 2007): a linear model on them approximates an RBF kernel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def scale_gamma(df: DataFrame, features) -> float:
    """1 / (p * variance of all entries)."""
    stats = df.agg(
        *[F.avg(F.col(f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.avg(F.col(f) * F.col(f)).alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    p = len(features)
    mean = sum(stats[f"m{i}"] for i in range(p)) / p
    variance = sum(stats[f"s{i}"] for i in range(p)) / p - mean * mean
    return 1.0 / (p * variance) if variance > 0 else 1.0 / p


def fourier_features(df: DataFrame, features, gamma: float, size=128, seed=42, out="x") -> DataFrame:
    """Vector column of sqrt(2/D) * cos(w . x + b) for seeded directions, an Arrow batch at a time."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), (len(features), size))
    b = rng.uniform(0.0, 2 * math.pi, size)

    @F.pandas_udf(ArrayType(DoubleType()))
    def project(x: pd.Series) -> pd.Series:
        z = np.cos(np.stack(x.to_numpy()) @ w + b) * math.sqrt(2.0 / size) if len(x) else np.zeros((0, size))
        return pd.Series(list(z))

    ready = VectorAssembler(inputCols=list(features), outputCol="_fx", handleInvalid="skip").transform(df)
    return ready.withColumn(out, array_to_vector(project(vector_to_array("_fx")))).drop("_fx")
