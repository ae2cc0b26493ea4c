"""Batch scoring with fitted models. No actions here, so rows may come from a stream as well."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monsoon.functions.labels import interval, province_name, quantile_risk_level, target_unit
from monsoon.functions.rounding import round_scalar
from monsoon.operators import climatology, contract, isolation, risk
from monsoon.operators.attribution import with_attributions
from monsoon.operators.isolation import IsolationForest
from monsoon.plans.features import CLIMATE_GROUPS, WEATHER_GROUPS, weather_frame
from monsoon.sources.artifacts import stage_path


def _version(metadata: Mapping) -> Column:
    return F.lit(metadata.get("model_version", "dev"))


def predict_weather_rows(df: DataFrame, model: PipelineModel, metadata: Mapping) -> DataFrame:
    """Scored rows in the shape of the prediction table: class and its probability."""
    at = F.col("datetime_local").cast("string") if "datetime_local" in df.columns else F.lit(None).cast("string")
    out = model.transform(weather_frame(df).withColumns(
        {"ref_year": F.try_to_number(F.substring(at, 1, 4), F.lit("9999")).cast("int"),
         "ref_month": F.try_to_number(F.substring(at, 6, 2), F.lit("99")).cast("int")}
    ))
    return out.select(
        F.lit("UC1").alias("use_case"),
        F.lit(metadata.get("model_name", "unknown")).alias("model_name"),
        _version(metadata).alias("model_version"),
        F.lit(metadata.get("target", "cuaca")).alias("target"),
        "predicted",
        F.array_max(vector_to_array("probability")).alias("proba"),
        "ref_year",
        "ref_month",
        "lat",
        "lon",
        *(["id"] if "id" in df.columns else []),
    )


def with_best_class(df: DataFrame, probability: Column, classes: list[str]) -> DataFrame:
    """Add predicted, proba and probabilities from an array of class probabilities.

    Probabilities are rounded to four digits first; the first of the largest rounded ones wins.
    """
    held = df.withColumn("__p", F.transform(probability, lambda p: round_scalar(p, 4)))
    names = F.array(*[F.lit(c) for c in classes])
    best = F.array_position("__p", F.array_max("__p")).cast("int")
    return held.withColumns(
        {
            "predicted": F.element_at(names, best),
            "proba": F.array_max("__p"),
            "probabilities": F.map_from_arrays(names, F.col("__p")),
        }
    ).drop("__p")


def predict_weather(
    df: DataFrame, model: PipelineModel, metadata: Mapping, model_path: str | None = None
) -> DataFrame:
    """Class, probability and probability map per row; rows outside the domain get nulls.

    With ``model_path`` (where the pipeline is stored) the top attributions are added.
    """
    marked = contract.with_broken_fields(df, contract.WEATHER_DOMAIN, ("datetime_local",))
    out = model.transform(weather_frame(marked))
    if model_path:
        at = len(model.stages) - 2
        forest = model.stages[at]
        out = with_attributions(out, stage_path(model_path, model, at), forest.treeWeights, WEATHER_GROUPS)
    # The pipeline's own prediction goes by the unrounded probabilities.
    out = with_best_class(out.drop("predicted"), vector_to_array("probability"), list(metadata["classes"]))
    valid = F.size("broken") == 0
    results = ["predicted", "proba", "probabilities", *(["shap"] if model_path else [])]
    return out.select(
        *df.columns, "broken", *[F.when(valid, F.col(c)).alias(c) for c in results], _version(metadata).alias("model_version")
    )


def _land_cover(df: DataFrame, cover: DataFrame | None) -> DataFrame:
    """Land cover of the nearest point; class 0, which no model has seen, when there is none."""
    if "landcover_class" in df.columns:
        return df
    if cover is not None:
        df = risk.with_land_cover(df, cover)
    if "landcover_class" not in df.columns:
        df = df.withColumn("landcover_class", F.lit(0))
    return df


def predict_climate(
    df: DataFrame,
    model: PipelineModel,
    metadata: Mapping,
    cover: DataFrame | None = None,
    model_path: str | None = None,
) -> DataFrame:
    """Monthly prediction with unit and interval; rows outside the domain get nulls."""
    target, half_width = metadata.get("target", "t2m"), metadata.get("ci_q90")
    filled = contract.with_defaults(df, contract.CLIMATE_DEFAULTS)
    marked = contract.with_broken_fields(filled, contract.CLIMATE_DOMAIN)
    valid = F.size("broken") == 0
    # The month is the one input without imputation: rejected rows get a stand-in, their result is null.
    rows = _land_cover(marked, cover).withColumns(
        {"__month": F.col("month"), "month": F.when(valid, F.col("month")).otherwise(F.lit(1))}
    )
    out = model.transform(rows.drop("predicted", target)).withColumn("month", F.col("__month")).drop("__month")
    extra = []
    if model_path:
        at = len(model.stages) - 1
        out = with_attributions(
            out, stage_path(model_path, model, at), model.stages[at].treeWeights, CLIMATE_GROUPS
        ).withColumn("shap", F.when(valid, F.col("shap")))
        extra = ["shap"]
    value = F.when(valid, F.col("predicted"))
    low, high = interval(value, half_width)
    keep = [c for c in filled.columns if c not in ("predicted", target)]
    return out.select(
        *keep,
        "broken",
        "landcover_class",
        F.lit(target).alias("target"),
        round_scalar(value, 2).alias("predicted"),
        target_unit(F.lit(target)).alias("unit"),
        low.alias("ci_low"),
        high.alias("ci_high"),
        _version(metadata).alias("model_version"),
        *extra,
    )


def predict_province(
    obs: DataFrame,
    model: PipelineModel,
    metadata: Mapping,
    province: str,
    month: int,
    year: int | None = None,
    cover: DataFrame | None = None,
) -> DataFrame:
    """One prediction per location of a province, each from its own mean inputs."""
    inputs = climatology.province_features(obs, province, month, year)
    target = metadata.get("target", "t2m")
    out = model.transform(_land_cover(inputs, cover))
    low, high = interval(F.col("predicted"), metadata.get("ci_q90"))
    digits = {"lat": 4, "lon": 4, "rh2m": 2, "ws2m": 2, "allsky_sfc_sw_dwn": 2, "predicted": 2}
    return out.select(
        F.lit(province_name(province)).alias("prov"),
        "month",
        F.lit(year).cast("int").alias("year"),
        F.lit(target).alias("target"),
        _version(metadata).alias("model_version"),
        "label",
        *[round_scalar(F.col(c), d).alias(c) for c, d in digits.items()],
        target_unit(F.lit(target)).alias("unit"),
        low.alias("ci_low"),
        high.alias("ci_high"),
    ).orderBy("label")


def predict_grid(points: DataFrame, model: PipelineModel, metadata: Mapping) -> DataFrame:
    """Temperature at arbitrary (lat, lon, month) points; a missing soil input takes the training median."""
    marked = contract.with_broken_fields(points, contract.GRID_DOMAIN)
    valid = F.size("broken") == 0
    rows = marked.withColumns(
        {"__month": F.col("month"), "month": F.when(valid, F.col("month")).otherwise(F.lit(1))}
    )
    out = model.transform(rows)
    return out.select(
        *[F.col("__month").alias("month") if c == "month" else F.col(c) for c in points.columns],
        "broken",
        F.when(valid, round_scalar(F.col("predicted"), 2)).alias("predicted_t2m_celsius"),
        _version(metadata).alias("model_version"),
    )


def score_disasters(training_set: DataFrame, model: PipelineModel, metadata: Mapping) -> DataFrame:
    """Predicted yearly events and risk class per region, highest first."""
    out = model.transform(training_set)
    if "q33" in metadata and "q66" in metadata:
        q33, q66 = F.lit(metadata["q33"]), F.lit(metadata["q66"])
    else:
        out = out.withColumn("__mean", out.agg(F.avg("predicted").alias("m")).scalar())
        q33, q66 = F.col("__mean"), F.col("__mean") * 1.5
    return out.select(
        "kode_wilayah",
        "nama_wilayah",
        round_scalar(F.col("lat"), 4).alias("lat"),
        round_scalar(F.col("lon"), 4).alias("lon"),
        F.coalesce("nearest_climate", F.lit("-")).alias("nearest_climate"),
        round_scalar(F.col("predicted"), 2).alias("predicted_kejadian"),
        quantile_risk_level(F.col("predicted"), q33, q66).alias("risk_level"),
    ).orderBy(F.desc("predicted_kejadian"), "kode_wilayah")


def check_anomalies(
    df: DataFrame, forest: IsolationForest, rules: Mapping | None = None, legacy: bool = False
) -> DataFrame:
    """Verdict, reason, score and method per row; missing rain and wind count as zero."""
    filled = contract.with_defaults(df, contract.ANOMALY_DEFAULTS)
    found = isolation.detect_anomalies(filled, forest.features, forest, rules, legacy_reason=legacy)
    return isolation.anomaly_verdict(found, legacy)


def model_info(spark, metadata: Mapping) -> DataFrame:
    """One row describing a stored model; an absent one is reported as not loaded."""
    about = {
        "model_loaded": bool(metadata),
        "model_name": metadata.get("model_name", "-"),
        "model_version": metadata.get("model_version", "-"),
        "target": metadata.get("target", "-"),
        "classes": list(metadata.get("classes", [])),
        "metrics": {k: float(v) for k, v in (metadata.get("metrics") or {}).items() if v is not None},
        "data_rows": int(metadata.get("data_rows", 0)),
    }
    schema = (
        "model_loaded boolean, model_name string, model_version string, target string, "
        "classes array<string>, metrics map<string,double>, data_rows long"
    )
    return spark.createDataFrame([tuple(about.values())], schema)
