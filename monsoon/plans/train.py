"""Training of the five use cases: check, evaluate, gate, fit on everything, store."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monsoon.operators import contract, isolation, risk
from monsoon.operators.isolation import IsolationForest
from monsoon.operators.order_stats import quantiles
from monsoon.plans import evaluate, models
from monsoon.plans.features import (
    SOIL,
    WEATHER_PERIODS,
    climate_inputs,
    grid_frame,
    weather_frame,
    weather_inputs,
)
from monsoon.sources.artifacts import save_artifact
from monsoon.sources.config import model_config

log = logging.getLogger("monsoon")

# Artefact names and the version label of unreleased models.
ARTIFACTS = {
    "UC1": "UC1_weather_clf_latest",
    "UC2": "UC2_climate_reg_latest",
    "UC3": "UC3_anomaly_detector_latest",
    "UC4": "UC4_spatial_interp_latest",
    "UC5": "UC5_disaster_risk_latest",
}
VERSION = "dev"
INTERVAL_SHARE = 0.90


@dataclass
class Trained:
    """A fitted model with its metadata; ``artifact`` is its path when it was stored."""

    model: PipelineModel | IsolationForest
    metadata: dict
    artifact: str | None = None


def _finish(df: DataFrame, model, metadata: dict, model_dir: str | None) -> Trained:
    use_case = metadata["use_case"]
    if not metadata.get("quality_gate_passed", True):
        log.warning("%s did not pass its quality gate; the model is kept and marked", use_case)
    artifact = None
    if model_dir:
        artifact = save_artifact(df.sparkSession, model, metadata, model_dir, ARTIFACTS[use_case])
    return Trained(model, metadata, artifact)


def _about(use_case: str, name: str, target: str, rows: int, result: dict) -> dict:
    about = {
        "use_case": use_case,
        "model_name": name,
        "model_version": VERSION,
        "target": target,
        "data_rows": rows,
        "metrics": result["model"],
        "baseline_metrics": result["baseline"],
        "quality_gate_passed": result["quality_gate_passed"],
    }
    if "skill_score" in result:
        about["skill_score"] = result["skill_score"]
    return about


def _gate(about: dict, cfg: dict) -> dict:
    """A configured skill threshold replaces the default of zero."""
    threshold = cfg.get("quality_gate", {}).get("threshold")
    if threshold is not None:
        about["quality_gate_passed"] = about["skill_score"] > threshold
    return about


def train_weather(
    df: DataFrame, cfg: dict | None = None, model_dir: str | None = None, rules: dict | None = None, order: str = "id"
) -> Trained:
    """UC-1: clean rows, enough of them, inside their ranges; classify the weather.

    ``gate_hyperparameters`` in the settings lets the gate judge another parameter set than the
    final fit (an empty one: the library defaults); ``periods`` changes the cyclical periods.
    """
    cfg = cfg or model_config("UC1")
    clean = contract.qc_clean(df)
    contract.require_min_rows(clean, rules)
    contract.require_ranges(clean, rules)
    target, name, hp = cfg["target"], cfg.get("model_name", "random_forest"), cfg.get("hyperparameters", {})
    counts = evaluate.class_counts(clean, target)
    result = evaluate.evaluate_weather(
        clean,
        target,
        cfg.get("cv", {}).get("n_splits", 5),
        cfg.get("quality_gate", {}).get("margin_over_baseline", 0.10),
        name,
        cfg.get("gate_hyperparameters", hp),
        order,
        cfg.get("periods"),
        counts,
    )
    classes = sorted(counts)
    rows = weather_frame(clean.filter(F.col(target).isNotNull()).select(*weather_inputs(clean, target, order)))
    labelled = models.with_balanced_weight(evaluate.with_label(rows, target, classes), counts, target)
    labelled = evaluate.kept_for_training(labelled, sum(counts.values()))
    model = models.fit_kept(models.weather_pipeline(classes, name, cfg.get("periods") or WEATHER_PERIODS, **hp), labelled)
    labelled.unpersist()
    about = {**_about("UC1", name, target, sum(counts.values()), result), "classes": [str(c) for c in classes]}
    return _finish(df, model, about, model_dir)


def train_climate(
    df: DataFrame,
    cfg: dict | None = None,
    cover: DataFrame | None = None,
    model_dir: str | None = None,
    **how,
) -> Trained:
    """UC-2: monthly climate regression with land cover when there is any, and a conformal half width."""
    cfg = cfg or model_config("UC2")
    clean = contract.qc_clean(df)
    use_landcover = False
    if cover is not None:
        try:
            enriched = risk.with_land_cover(clean, cover)
            use_landcover = "landcover_class" in enriched.columns
            clean = enriched
        except Exception as exc:  # noqa: BLE001 - land cover is an optional extra
            log.warning("training without land cover: %s", exc)
    target = cfg.get("target", "t2m")
    name, hp = cfg.get("model_name", "gradient_boosting"), cfg.get("hyperparameters", {})
    rows = clean.count()
    wanted = cfg.get("cv", {}).get("n_splits", 5)
    pipeline = models.climate_pipeline(target, use_landcover, name, **hp)
    k = evaluate.splits_for_climate(rows, wanted)
    k_interval = evaluate.splits_for_interval(rows)
    # The same folds serve the gate and the interval whenever their numbers agree.
    share = INTERVAL_SHARE if k == k_interval else None
    kept = evaluate.kept_for_training(clean.select(*climate_inputs(clean, target, how.get("order", "id"))), rows)
    try:
        result = evaluate.evaluate_regression(kept, pipeline, target, k, rows, interval_share=share, **how)
        half_width = result.get("half_width")
        if half_width is None:
            half_width = evaluate.evaluate_regression(
                kept, pipeline, target, k_interval, rows, interval_share=INTERVAL_SHARE, **how
            )["half_width"]
        model = models.fit_kept(pipeline, kept)
    finally:
        kept.unpersist()
    about = {**_about("UC2", name, target, rows, result), "ci_q90": half_width, "use_landcover": use_landcover}
    return _finish(df, model, _gate(about, cfg), model_dir)


def train_anomaly(
    df: DataFrame, cfg: dict | None = None, model_dir: str | None = None, rules: dict | None = None, key: str = "id"
) -> Trained:
    """UC-3: isolation forest over the clean rows and whichever of its features exist."""
    cfg = cfg or model_config("UC3")
    clean = contract.qc_clean(df)
    contract.require_min_rows(clean, rules)
    features = [c for c in isolation.ANOMALY_FEATURES if c in clean.columns]
    if not features:
        raise RuntimeError(f"none of the anomaly features is present: {isolation.ANOMALY_FEATURES}")
    contamination = cfg.get("contamination", isolation.CONTAMINATION)
    forest = isolation.fit_forest(clean, features, key, contamination, **cfg.get("hyperparameters", {}))
    about = {
        "use_case": "UC3",
        "model_name": "isolation_forest",
        "model_version": VERSION,
        "feature_cols": features,
        "data_rows": clean.count(),
        "contamination": contamination,
    }
    return _finish(df, forest, about, model_dir)


def train_grid(df: DataFrame, cfg: dict | None = None, model_dir: str | None = None, **how) -> Trained:
    """UC-4: temperature at any point and month from the reanalysis grid."""
    cfg = cfg or model_config("UC4")
    contract.require_rows(df, "the grid table is empty", RuntimeError)
    target, hp = cfg.get("target", "t2m_celsius"), cfg.get("hyperparameters", {})
    result = evaluate.evaluate_grid(df, target, cfg.get("cv", {}).get("n_splits", 5), hp, **how)
    prepared = grid_frame(df, target)
    use_soil = SOIL in prepared.columns
    model = models.grid_pipeline(target, use_soil, **hp).fit(prepared)
    about = {
        **_about("UC4", cfg.get("model_name", "random_forest"), target, df.count(), result),
        "use_soil": use_soil,
        "data_source": "era5_land" if use_soil else "era5_monthly",
    }
    return _finish(df, model, _gate(about, cfg), model_dir)


def train_disaster(
    disasters: DataFrame, obs: DataFrame, cfg: dict | None = None, model_dir: str | None = None
) -> Trained:
    """UC-5: yearly disaster frequency from the climate of the nearest location."""
    cfg = cfg or model_config("UC5")
    contract.require_rows(disasters, "the disaster table is empty", RuntimeError)
    contract.require_rows(obs, "the climate table is empty", RuntimeError)
    rows = risk.disaster_training_set(disasters, obs)
    target, hp = risk.DISASTER_TARGET, cfg.get("hyperparameters", {})
    n = rows.count()
    pipeline = models.disaster_pipeline(target, **hp)
    result = evaluate.evaluate_regression(
        rows, pipeline, target, evaluate.splits_for_disaster(n), n, order="kode_wilayah"
    )
    q33, q66 = quantiles(rows, target, [0.33, 0.66])
    about = {
        **_about("UC5", "gradient_boosting", target, n, result),
        "feature_cols": risk.DISASTER_FEATURES,
        "q33": q33,
        "q66": q66,
    }
    return _finish(disasters, pipeline.fit(rows), about, model_dir)
