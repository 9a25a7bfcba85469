"""Estimators by name, with the reference parameter names translated to MLlib's."""

from __future__ import annotations

from itertools import product

from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.models.gram import Linear

# Default settings of each model.
DEFAULTS = {
    "logistic": {"C": 0.1, "max_iter": 2000, "class_weight": "balanced"},
    "svm": {"C": 1.0, "max_iter": 200, "tol": 1e-3},
    "random_forest": {"n_estimators": 100, "max_depth": 10, "min_samples_leaf": 5, "max_samples": 0.8},
    "mlp": {"hidden_layer_sizes": (64, 32), "max_iter": 200, "tol": 1e-6},
    "linear": {},
    "ridge": {"alpha": 1.0},
    "elastic_net": {"alpha": 0.01, "l1_ratio": 0.5},
    "svr": {"C": 1.0, "epsilon": 0.1},
    "random_forest_regressor": {"n_estimators": 100, "max_depth": 10, "min_samples_leaf": 20},
}

# Models whose fit takes row weights.
WEIGHTED = {"linear": True, "ridge": True, "elastic_net": True, "svr": False, "random_forest_regressor": True, "mlp": False, "logistic": True, "svm": True, "random_forest": True}


def supports_weights(name: str, config: dict | None = None) -> bool:
    """Whether the model takes row weights; a configured value wins over the default."""
    return bool((config or {}).get(name, {}).get("supports_sample_weight", WEIGHTED.get(name, False)))


def settings(name: str, config: dict | None = None) -> dict:
    return {**DEFAULTS[name], **(config or {}).get(name, {})}


def linear_model(name: str, config: dict | None = None) -> Linear:
    s = settings(name, config)
    return Linear(name, float(s.get("alpha", 0.0)), float(s.get("l1_ratio", 0.0)))


def classifier(name: str, features: int, weight_sum: float, seed=42, weight: str | None = None, **params):
    """An MLlib classifier on vector column `x` and label `y`.

    Penalties are per unit of weight in MLlib, hence C becomes 1 / (C * total weight).
    """
    s = {**DEFAULTS[name], **params}
    if name == "logistic":
        model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / (s["C"] * weight_sum), standardization=False, maxIter=s["max_iter"])
    elif name == "svm":
        model = LinearSVC(featuresCol="x", labelCol="y", regParam=1 / (s["C"] * weight_sum), standardization=False, maxIter=s["max_iter"], tol=s["tol"])
    elif name == "random_forest":
        model = RandomForestClassifier(
            featuresCol="x", labelCol="y", numTrees=s["n_estimators"], maxDepth=s["max_depth"], minInstancesPerNode=s["min_samples_leaf"],
            subsamplingRate=s["max_samples"], featureSubsetStrategy="sqrt", seed=seed,
        )
    elif name == "mlp":
        layers = [features, *s["hidden_layer_sizes"], 2]
        return MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=layers, maxIter=s["max_iter"], tol=s["tol"], seed=seed)
    else:
        raise ValueError(f"unknown classifier {name!r}")
    return model.setWeightCol(weight) if weight else model


def regressor(name: str, seed=42, weight: str | None = None, rows: float = 1.0, y_sd: float = 1.0, **params):
    """An MLlib regressor on vector column `x` and label `y`.

    MLlib standardises the label, which divides the quadratic part of its penalty by the label's population SD and
    leaves the absolute part alone; `y_sd` and the total weight `rows` undo that, so alpha means what it says.
    """
    s = {**DEFAULTS[name], **params}
    if name == "random_forest_regressor":
        model = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=s["n_estimators"], maxDepth=s["max_depth"], minInstancesPerNode=s["min_samples_leaf"], seed=seed)
    elif name in ("linear", "ridge", "elastic_net"):
        alpha, l1 = s.get("alpha", 0.0), s.get("l1_ratio", 0.0)
        absolute, square = alpha * l1, (alpha * (1 - l1) if l1 else alpha / rows) * y_sd
        total = absolute + square
        model = LinearRegression(featuresCol="x", labelCol="y", regParam=total, elasticNetParam=absolute / total if total else 0.0, standardization=False)
    else:
        raise ValueError(f"unknown regressor {name!r}")
    return model.setWeightCol(weight) if weight else model


def assemble(df: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="skip").transform(df)


def score_of(predictions: DataFrame, probability: bool) -> DataFrame:
    """Positive-class score: probability where the model has one, else the margin."""
    from pyspark.ml.functions import vector_to_array

    source = "probability" if probability else "rawPrediction"
    return predictions.withColumn("score", F.get(vector_to_array(source), F.lit(1)))


HAS_PROBABILITY = {"logistic": True, "svm": False, "random_forest": True, "mlp": True}


def parameter_grid(grid: dict) -> list[dict]:
    """Every combination, in the order of the grid."""
    names = list(grid)
    return [dict(zip(names, values)) for values in product(*[grid[n] for n in names])]
