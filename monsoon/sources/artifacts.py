"""Fitted models with a metadata record next to them, on any file system Spark can write to."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from monsoon.operators.isolation import IsolationForest


def _put_text(spark: SparkSession, path: str, value: dict) -> None:
    line = spark.createDataFrame([(json.dumps(value),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(path)


def save_artifact(
    spark: SparkSession, model: PipelineModel | IsolationForest, metadata: dict, model_dir: str, name: str
) -> str:
    """Store model and metadata under ``model_dir/name`` and return that path."""
    path = f"{model_dir}/{name}"
    if isinstance(model, IsolationForest):
        model.save(spark, f"{path}/model")
        metadata = {**metadata, "kind": "isolation_forest"}
    else:
        model.write().overwrite().save(f"{path}/model")
    _put_text(spark, f"{path}/about", metadata)
    return path


def load_metadata(spark: SparkSession, path: str) -> dict:
    """The metadata record, empty when there is none."""
    try:
        row = spark.read.text(f"{path}/about").first()
    except AnalysisException:
        return {}
    return json.loads(row["value"]) if row else {}


def load_artifact(spark: SparkSession, path: str) -> tuple[PipelineModel | IsolationForest, dict]:
    metadata = load_metadata(spark, path)
    if metadata.get("kind") == "isolation_forest":
        return IsolationForest.load(spark, f"{path}/model"), metadata
    return PipelineModel.load(f"{path}/model"), metadata


def stage_path(model_path: str, model: PipelineModel, at: int) -> str:
    """Where a saved pipeline keeps stage ``at``."""
    width = len(str(len(model.stages)))
    return f"{model_path}/stages/{at:0{width}d}_{model.stages[at].uid}"
