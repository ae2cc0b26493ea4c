"""Quality metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """mae, rmse and r2; r2 of a constant target is 1 when perfect, else 0."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    err = y - p
    stats = df.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"),
        F.var_pop(y).alias("var"),
    )
    r2 = (
        F.when(F.col("var") > 0, 1.0 - F.col("mse") / F.col("var"))
        .when(F.col("mse") == 0, F.lit(1.0))
        .when(F.col("mse").isNotNull(), F.lit(0.0))
    )
    return stats.select(*by, "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def class_f1(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """F1 and support for every label seen as truth or as prediction (0 when undefined)."""
    cells = df.groupBy(*by, F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # One confusion cell adds to the row of its true label and to that of its predicted label.
    n, hit = F.col("n"), (F.col("t") == F.col("p"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("t").alias("label"), n.alias("support"), zero.alias("called"),
            F.when(hit, n).otherwise(zero).alias("tp"),
        ),
        F.struct(F.col("p").alias("label"), zero.alias("support"), n.alias("called"), zero.alias("tp")),
    )
    per = (
        cells.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("tp").alias("tp"))
    )
    f1 = F.lit(2.0) * F.col("tp") / (F.col("support") + F.col("called"))
    return per.select(*by, "label", "support", f1.alias("f1"))


def classification_metrics(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """macro_f1 and weighted_f1 over the union of true and predicted labels."""
    per = class_f1(df, truth, predicted, by)
    return per.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def baseline_mean(df: DataFrame, target: str, fold: str = "fold") -> DataFrame:
    """(fold, prediction): the target mean over the other folds, from one pass."""
    per = df.groupBy(fold).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    total = per.agg(F.struct(F.sum("s").alias("s"), F.sum("n").alias("n"))).scalar()
    rest = (F.col("__all.s") - F.col("s")) / (F.col("__all.n") - F.col("n"))
    return per.withColumn("__all", total).select(fold, rest.alias("prediction"))


def baseline_mode(df: DataFrame, target: str, fold: str = "fold") -> DataFrame:
    """(fold, prediction): the most frequent label over the other folds, ties to the smallest."""
    cells = df.filter(F.col(target).isNotNull()).groupBy(fold, target).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy(target).agg(F.sum("n").alias("all_n"), F.collect_list(F.struct(fold, "n")).alias("own"))
    folds = cells.agg(F.array_sort(F.collect_set(fold))).scalar()
    rest = totals.select(target, "all_n", "own", F.explode(folds).alias(fold))
    own_n = F.aggregate(
        F.filter("own", lambda e: e[fold] == F.col(fold)), F.lit(0).cast("long"), lambda a, e: a + e["n"]
    )
    left = rest.select(fold, target, (F.col("all_n") - own_n).alias("n"))
    return left.groupBy(fold).agg(F.min_by(target, F.struct(-F.col("n"), F.col(target))).alias("prediction"))
