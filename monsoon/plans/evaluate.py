"""Cross-validation, baselines and quality gates."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monsoon.operators import folds, metrics
from monsoon.operators.order_stats import quantiles
from monsoon.plans import models
from monsoon.plans.features import WEATHER_PERIODS, grid_frame, weather_frame, weather_inputs

_PARALLEL_FOLDS = 5
#: Rows that folds fitted side by side hold in all; each fold has its own copy of the rows that it learns from.
_ROWS_AT_ONCE = 8_000_000
#: Partitions of a training frame at least, and rows of one at most; ``monsoon.training.partitions`` in the session sets another number.
_TRAINING_PARTITIONS = 8
_PARTITION_ROWS = 500_000

# How many folds a table of n rows (or a smallest class) gets.


def splits_for_classes(smallest_class: int, wanted: int = 5) -> int:
    return max(2, min(wanted, smallest_class, 5))


def splits_for_climate(n: int, wanted: int = 5) -> int:
    return max(2, min(wanted, n // 4))


def splits_for_interval(n: int) -> int:
    return min(5, max(2, n // 10))


def splits_for_grid(n: int, wanted: int = 5) -> int:
    return max(2, min(wanted, n // 10))


def splits_for_disaster(n: int) -> int:
    return max(2, min(5, n // 20))


def assign_folds(df: DataFrame, k: int, order: str = "id", mode: str = "contiguous") -> DataFrame:
    """Blocks along the row order, or hashed folds: no pass over the data at all."""
    if mode == "hashed":
        return folds.hashed_folds(df, k, [order])
    if mode != "contiguous":
        raise ValueError(f"unknown fold mode '{mode}'")
    if not isinstance(df.schema[order].dataType, T.NumericType):
        df = folds.with_order_column(df, [order])
        return folds.contiguous_folds(df, k, "row_order").drop("row_order")
    return folds.contiguous_folds(df, k, order)


def kept_for_training(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cache a frame that is read many times, in a layout that the rows alone decide.

    Bagged trees draw rows by partition, so a model would else depend on the cores and on how the input was split.
    The number of partitions goes by the counted rows, or is a setting; rows are dealt out by their hash and sorted.
    """
    parts = max(_TRAINING_PARTITIONS, -(-(rows or 0) // _PARTITION_ROWS))
    wanted = int(df.sparkSession.conf.get("monsoon.training.partitions", str(parts)))
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant", "vector"))]
    return df.repartition(wanted, *plain).sortWithinPartitions(*plain).persist(StorageLevel.MEMORY_AND_DISK)


def folds_at_once(k: int, rows: int) -> int:
    """So many that their copies of the rows stay within a bound: all folds of a small table, one of a large one."""
    return max(1, min(k, _PARALLEL_FOLDS, _ROWS_AT_ONCE // max(1, rows)))


def out_of_fold(
    folded: DataFrame, k: int, fit: Callable[[DataFrame, int], PipelineModel], keep: list[str], rows: int = 0
) -> DataFrame:
    """Predictions of k models, each for the rows it has not seen. Folds are fitted side by side while ``rows`` are few."""

    @inheritable_thread_target(folded.sparkSession)
    def one(i: int) -> DataFrame:
        model = fit(folded.filter(F.col("fold") != i), i)
        return model.transform(folded.filter(F.col("fold") == i)).select(*keep)

    pool = ThreadPool(folds_at_once(k, rows))
    try:
        parts = pool.map(one, range(k), chunksize=1)
    finally:
        pool.close()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _one(df: DataFrame) -> dict:
    return df.first().asDict()


def _regression_result(folded: DataFrame, oof: DataFrame, target: str) -> dict:
    base = metrics.baseline_mean(folded, target)
    # One row per fold: the lookup is tiny by construction.
    based = folded.select("fold", target).join(F.broadcast(base), "fold")
    model_m = _one(metrics.regression_metrics(oof, target, "predicted"))
    base_m = _one(metrics.regression_metrics(based, target, "prediction"))
    skill = 0.0 if base_m["mae"] == 0 else 1.0 - model_m["mae"] / base_m["mae"]
    return {"model": model_m, "baseline": base_m, "skill_score": skill, "quality_gate_passed": bool(skill > 0)}


def evaluate_regression(
    df: DataFrame,
    pipeline,
    target: str,
    k: int,
    rows: int,
    order: str = "id",
    fold_mode: str = "contiguous",
    interval_share: float | None = None,
) -> dict:
    """Model and mean baseline over the same folds; optionally the quantile of |residual|.

    A frame the caller has cached is not cached again: the fold number is cheap to work out.
    """
    folded = assign_folds(df, k, order, fold_mode)
    if not df.is_cached:
        folded = kept_for_training(folded, rows)
    oof = out_of_fold(folded, k, lambda seen, _: models.fit_kept(pipeline, seen), [target, "predicted"], rows)
    oof.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        result = {**_regression_result(folded, oof, target), "splits": k}
        if interval_share is not None:
            residual = oof.select(F.abs(F.col(target) - F.col("predicted")).alias("r"))
            result["half_width"] = round(quantiles(residual, "r", [interval_share])[0], 4)
    finally:
        oof.unpersist()
        if not df.is_cached:
            folded.unpersist()
    return result


def class_counts(df: DataFrame, target: str) -> dict:
    """Rows per class, null left out."""
    rows = df.filter(F.col(target).isNotNull()).groupBy(target).count().collect()
    return {r[target]: r["count"] for r in rows}


def with_label(df: DataFrame, target: str, classes: list) -> DataFrame:
    """Add the class number, with the class list as column metadata, so every fold agrees on it."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target))
    number = F.when(place > 0, (place - 1).cast("double"))
    about = {"ml_attr": {"type": "nominal", "vals": [str(c) for c in classes]}}
    return df.withColumn("label", number.alias("label", metadata=about))


def evaluate_weather(
    df: DataFrame,
    target: str = "cuaca",
    n_splits: int = 5,
    margin: float = 0.10,
    model_name: str = "random_forest",
    hyperparameters: dict | None = None,
    order: str = "id",
    periods: dict | None = None,
    counts: dict | None = None,
) -> dict:
    """Macro-F1 of the classifier against always naming the most frequent class."""
    hp = hyperparameters or {}
    counts = class_counts(df, target) if counts is None else counts
    classes = sorted(counts)
    k = splits_for_classes(min(counts.values()), n_splits)
    folded = folds.stratified_folds(df.filter(F.col(target).isNotNull()), k, target, order)
    folded = folded.select("fold", *weather_inputs(df, target, order))
    folded = kept_for_training(with_label(weather_frame(folded), target, classes), sum(counts.values()))
    cells = folded.groupBy("fold", target).count().collect()

    def fit(rows: DataFrame, i: int) -> PipelineModel:
        seen: dict = {}
        for c in cells:
            if c["fold"] != i:
                seen[c[target]] = seen.get(c[target], 0) + c["count"]
        weighted = models.with_balanced_weight(rows, seen, target)
        return models.fit_kept(models.weather_pipeline(classes, model_name, periods or WEATHER_PERIODS, **hp), weighted)

    oof = out_of_fold(folded, k, fit, [target, "predicted"], sum(counts.values()))
    try:
        model_m = _one(metrics.classification_metrics(oof, target, "predicted"))
        base = metrics.baseline_mode(folded, target)
        based = folded.select("fold", target).join(F.broadcast(base), "fold")
        base_m = _one(metrics.classification_metrics(based, target, "prediction"))
    finally:
        folded.unpersist()
    passed = model_m["macro_f1"] >= base_m["macro_f1"] + margin
    return {"model": model_m, "baseline": base_m, "quality_gate_passed": bool(passed), "margin": margin, "splits": k}


def evaluate_climate(
    df: DataFrame,
    target: str = "t2m",
    n_splits: int = 5,
    use_landcover: bool = False,
    model_name: str = "gradient_boosting",
    hyperparameters: dict | None = None,
    interval_share: float | None = None,
    **how,
) -> dict:
    rows = df.count()
    pipeline = models.climate_pipeline(target, use_landcover, model_name, **(hyperparameters or {}))
    return evaluate_regression(
        df, pipeline, target, splits_for_climate(rows, n_splits), rows, interval_share=interval_share, **how
    )


def evaluate_grid(
    df: DataFrame, target: str = "t2m_celsius", n_splits: int = 5, hyperparameters: dict | None = None, **how
) -> dict:
    prepared = grid_frame(df, target, how.get("order", "id"))
    rows = df.count()
    pipeline = models.grid_pipeline(target, "soil_temp_c" in prepared.columns, **(hyperparameters or {}))
    return evaluate_regression(prepared, pipeline, target, splits_for_grid(rows, n_splits), rows, **how)
