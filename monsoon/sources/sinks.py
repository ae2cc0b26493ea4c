"""Result tables: predictions and anomalies, written as partitioned Parquet."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monsoon.functions.spatial import point_wkt
from monsoon.session import cut_lineage
from monsoon.sources.key_filter import KeyFilter, exists

# Columns and types of the result tables, and the unique key of a prediction. The number of the source
# row is part of the key: two rows of one place and month are two predictions.
PREDICTION_COLUMNS = {
    "use_case": "string",
    "model_name": "string",
    "model_version": "string",
    "target": "string",
    "predicted": "string",
    "proba": "double",
    "ref_year": "int",
    "ref_month": "int",
    "geom": "string",
    "source_id": "long",
    "predicted_at": "timestamp",
}
PREDICTION_KEY = ["use_case", "model_version", "target", "ref_year", "ref_month", "geom", "source_id"]
PARTITIONS = ["use_case", "model_version"]
ANOMALY_COLUMNS = {
    "source_table": "string",
    "source_id": "long",
    "is_anomaly": "boolean",
    "anomaly_score": "double",
    "reason": "string",
    "geom": "string",
    "detected_at": "timestamp",
}


def _shaped(df: DataFrame, columns: dict[str, str], stamp: str, keep: Sequence[str] = ()) -> DataFrame:
    if "geom" not in df.columns and {"lat", "lon"} <= set(df.columns):
        df = df.withColumn("geom", point_wkt(F.col("lat"), F.col("lon")))
    if stamp not in df.columns:
        df = df.withColumn(stamp, F.current_timestamp())
    return df.select(
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()],
        *[c for c in keep if c not in columns],
    )


def prediction_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Scored rows in the shape of the prediction table (numbers become text)."""
    if "source_id" not in df.columns and "id" in df.columns:
        df = df.withColumn("source_id", F.col("id"))
    return _shaped(df, PREDICTION_COLUMNS, "predicted_at", keep)


def anomaly_rows(df: DataFrame, source_table: str, id_col: str = "id") -> DataFrame:
    named = df.withColumns({"source_table": F.lit(source_table), "source_id": F.col(id_col)})
    return _shaped(named, ANOMALY_COLUMNS, "detected_at")


def _append(df: DataFrame, path: str, partitions: Sequence[str]) -> int:
    """Append and count.

    The rows are written to the shared scratch folder first: their number is in the footers of those files, and a retry of
    the append copies rows instead of scoring them again.
    """
    rows = cut_lineage(df)
    rows.write.mode("append").partitionBy(*partitions).parquet(path)
    return rows.count()


def rows_to_append(
    new: DataFrame, stored: DataFrame | None, key: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """First new row per key, by ``order``, whose key is not stored yet; nulls in a key equal each other."""
    if not order:
        raise ValueError("order decides which row of a key counts; name a column")
    rest = [c for c in new.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    unique = new.groupBy(*key).agg(first).select(*key, "__row.*")
    if stored is None:
        return unique
    known = stored.select(*[F.col(c).alias(f"__{c}") for c in key])
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
    return unique.join(known, same, "left_anti")


def stored_predictions(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as it was written, or None if there is none yet.

    The schema is given: types inferred from folder names would take version 1.10 for 1.1. A table that is there but
    can't be read raises.
    """
    if not exists(spark, path):
        return None
    return spark.read.schema(", ".join(f"{c} {t}" for c, t in PREDICTION_COLUMNS.items())).parquet(path)


def write_predictions(df: DataFrame, path: str, idempotent: bool = False, order: Sequence[str] = ()) -> int:
    """Append predictions and return how many rows were written.

    ``idempotent`` keeps one row per key and skips keys the table already holds, so a repeated run adds nothing (only files
    whose key filter lets one of the keys through are read, see ``key_filter``);
    ``order`` then has to name the columns of ``df`` that decide which row of a key counts. Rows that neither a source
    row nor a month tells apart aren't taken for repeats of each other: they are all written.
    """
    rows = prediction_rows(df, order if idempotent else ())
    if idempotent:
        # Written once, as the rows are read for the filters and for the append: they are not scored again.
        rows = cut_lineage(rows)
        known = F.col("source_id").isNotNull() | (F.col("ref_year").isNotNull() & F.col("ref_month").isNotNull())
        stored = stored_predictions(df.sparkSession, path)
        if stored is not None:
            stored = KeyFilter(stored, path, PREDICTION_KEY, PARTITIONS).may_hold(rows.filter(known))
        fresh = rows_to_append(rows.filter(known), stored, PREDICTION_KEY, order).select(*PREDICTION_COLUMNS)
        rows = fresh.unionByName(rows.filter(~known).select(*PREDICTION_COLUMNS))
    return _append(rows, path, PARTITIONS)


def write_anomalies(df: DataFrame, path: str, source_table: str, id_col: str = "id") -> int:
    """Append anomaly verdicts of a source table and return how many rows were written."""
    return _append(anomaly_rows(df, source_table, id_col), path, ["source_table"])
