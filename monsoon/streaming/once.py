"""Exactly-once result tables from streams.

A micro-batch that fails after its write, or before its commit is stored, is run again with the same number. So the number of
the batch, and the name of the stream, are part of the key of every row: they are the partition that the batch is written
to, and a replay replaces its own partition instead of adding to the table. Batches only ever see rows of *earlier* batches
when they leave out keys that are stored, so a replay makes the same decisions again.

A stream's name belongs to its checkpoint: a stream that starts anew, from batch 0, needs a new name.

Defined results: empty batches write nothing; rows whose key holds only nulls beside the model are never taken for repeats;
of equal keys in one batch the first by ``order`` counts; nulls in a key equal each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from monsoon.session import cut_lineage
from monsoon.sources.key_filter import KeyFilter, exists
from monsoon.sources.sinks import PREDICTION_COLUMNS, PREDICTION_KEY, prediction_rows, rows_to_append

BATCH = ["stream", "batch"]


def stored_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """The predictions of all streams with ``stream`` and ``batch``, or None before the first batch."""
    if not exists(spark, path):
        return None
    columns = PREDICTION_COLUMNS | {"stream": "string", "batch": "long"}
    return spark.read.schema(", ".join(f"{c} {t}" for c, t in columns.items())).parquet(path)


def write_batch(rows: DataFrame, path: str, stream: str, batch: int) -> None:
    """Write one batch; the partition of an earlier attempt is replaced when the job commits, not before."""
    marked = rows.withColumns({"stream": F.lit(stream), "batch": F.lit(int(batch)).cast("long")})
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BATCH).parquet(path)


def prediction_batch(
    scored: DataFrame, path: str, stream: str, batch: int, order: Sequence[str], unique: bool = True
) -> None:
    """Write the predictions of a batch; ``unique`` leaves out keys of this stream's earlier batches and other streams."""
    rows = prediction_rows(scored, order)
    if unique:
        known = F.col("source_id").isNotNull() | (F.col("ref_year").isNotNull() & F.col("ref_month").isNotNull())
        stored = stored_batches(scored.sparkSession, path)
        if stored is not None:
            # Scored once, for the filters and for the write.
            rows = cut_lineage(rows)
            earlier = stored.filter((F.col("stream") != stream) | (F.col("batch") < batch))
            stored = KeyFilter(earlier, path, PREDICTION_KEY).may_hold(rows.filter(known))
        fresh = rows_to_append(rows.filter(known), stored, PREDICTION_KEY, order).select(*PREDICTION_COLUMNS)
        rows = fresh.unionByName(rows.filter(~known).select(*PREDICTION_COLUMNS))
    write_batch(rows.select(*PREDICTION_COLUMNS), path, stream, batch)


def write_once(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    name: str,
    order: Sequence[str],
    score: Callable[[DataFrame], DataFrame] | None = None,
    unique: bool = True,
    available_now: bool = False,
    **trigger: str,
) -> StreamingQuery:
    """Predictions of a stream, each batch once; ``score`` is a batch function (for example a join that has no stream form)."""

    def batch(rows: DataFrame, number: int) -> None:
        prediction_batch(score(rows) if score else rows, path, name, number, order, unique)

    when = {"availableNow": True} if available_now else (trigger or {"processingTime": "1 minute"})
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**when).start()
