"""Named estimators and model pipelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monsoon.operators.risk import DISASTER_FEATURES
from monsoon.plans.features import (
    WEATHER_PERIODS,
    climate_stages,
    disaster_stages,
    grid_stages,
    weather_stages,
)

SEED = 42
MOST_FREQUENT, MEAN = "most_frequent", "mean"
_DEEPEST = 30
_WEIGHT = "row_weight"


def _forest_params(p: dict) -> dict:
    return {
        "numTrees": int(p.pop("n_estimators", 100)),
        "maxDepth": int(p.pop("max_depth", None) or _DEEPEST),
        "minInstancesPerNode": int(p.pop("min_samples_leaf", 1)),
        "seed": int(p.pop("random_state", SEED)),
        "maxBins": int(p.pop("max_bins", 32)),
    }


def _forest_classifier(p: dict):
    p.pop("class_weight", None)  # balanced weights are a column, see weather_pipeline
    return RandomForestClassifier(featureSubsetStrategy="sqrt", **_forest_params(p))


def _forest_regressor(p: dict):
    return RandomForestRegressor(featureSubsetStrategy="all", **_forest_params(p))


def _boosting(p: dict):
    return GBTRegressor(
        maxIter=int(p.pop("n_estimators", 100)),
        maxDepth=int(p.pop("max_depth", 3)),
        stepSize=float(p.pop("learning_rate", 0.1)),
        minInstancesPerNode=int(p.pop("min_samples_leaf", 1)),
        seed=int(p.pop("random_state", SEED)),
        maxBins=int(p.pop("max_bins", 32)),
    )


# Estimator names used by the configuration files.
_ESTIMATORS = {
    "random_forest": _forest_classifier,
    "random_forest_reg": _forest_regressor,
    "gradient_boosting": _boosting,
    "dummy_clf": lambda p: {"strategy": p.pop("strategy", MOST_FREQUENT)},
    "dummy_reg": lambda p: {"strategy": p.pop("strategy", MEAN)},
}


def make_estimator(name: str, **params):
    """Estimator by configuration name. The two baselines are plain descriptions: they are
    aggregates over folds (``monsoon.operators.metrics``), not fitted stages."""
    if name not in _ESTIMATORS:
        raise KeyError(f"unknown model '{name}', choose from {sorted(_ESTIMATORS)}")
    rest = dict(params)
    made = _ESTIMATORS[name](rest)
    if rest:
        raise TypeError(f"unknown parameters for '{name}': {sorted(rest)}")
    return made


def with_balanced_weight(df: DataFrame, counts: Mapping[object, int], target: str) -> DataFrame:
    """Row weight n / (classes * rows of the class), from class counts already at hand."""
    total, classes = sum(counts.values()), len(counts)
    weight = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col(target) == F.lit(label), F.lit(total / (classes * n))).otherwise(weight)
    return df.withColumn(_WEIGHT, weight)


def weather_pipeline(
    classes: Sequence[str],
    name: str = "random_forest",
    periods: Mapping[str, float] = WEATHER_PERIODS,
    **params,
) -> Pipeline:
    """Weather classes; training rows carry ``label`` numbers. ``class_weight='balanced'`` reads the
    weight column."""
    estimator = make_estimator(name, **params)
    estimator.setFeaturesCol("features").setLabelCol("label")
    if params.get("class_weight") == "balanced":
        estimator.setWeightCol(_WEIGHT)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=[str(c) for c in classes])
    return Pipeline(stages=[*weather_stages(periods), estimator, back])


def _regression(stages: list[Transformer | Estimator], target: str, estimator) -> Pipeline:
    estimator.setFeaturesCol("features").setLabelCol(target).setPredictionCol("predicted")
    return Pipeline(stages=[*stages, estimator])


def climate_pipeline(target: str, use_landcover: bool = False, name: str = "gradient_boosting", **params) -> Pipeline:
    return _regression(climate_stages(use_landcover), target, make_estimator(name, **params))


def grid_pipeline(target: str, use_soil: bool = False, **params) -> Pipeline:
    return _regression(grid_stages(use_soil), target, make_estimator("random_forest_reg", **params))


def disaster_pipeline(target: str, features: Sequence[str] = DISASTER_FEATURES, **params) -> Pipeline:
    chosen = {"n_estimators": 200, "max_depth": 3, "learning_rate": 0.05, **params}
    return _regression(disaster_stages(features), target, make_estimator("gradient_boosting", **chosen))


def fit_kept(pipeline: Pipeline, rows: DataFrame) -> PipelineModel:
    """``pipeline.fit`` with the inputs of its tree ensemble worked out once and kept.

    The ensemble reads them several times before it holds its own copy. The last estimator is the ensemble; the kept
    rows have the partitions and the order of ``rows``, so the model is the one that ``pipeline.fit`` gives.
    """
    stages = pipeline.getStages()
    at = max(i for i, stage in enumerate(stages) if isinstance(stage, Estimator))
    ensemble = stages[at]
    wanted = [ensemble.getFeaturesCol(), ensemble.getLabelCol()]
    if ensemble.isDefined("weightCol") and ensemble.getWeightCol():
        wanted.append(ensemble.getWeightCol())
    before = Pipeline(stages=stages[:at]).fit(rows)
    inputs = before.transform(rows).select(*wanted).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = ensemble.fit(inputs)
    finally:
        inputs.unpersist()
    return PipelineModel([*before.stages, fitted, *stages[at + 1 :]])
