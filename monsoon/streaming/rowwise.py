"""QC and anomaly verdicts on a stream.

The batch operators used here look at one row at a time, so the same code runs on a streaming
frame; there is no state, and the sink's checkpoint gives exactly-once files.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from monsoon.operators.contract import rule_flags
from monsoon.operators.isolation import IsolationForest
from monsoon.plans.score import check_anomalies
from monsoon.sources.sinks import anomaly_rows


def flagged(stream: DataFrame, rules: Mapping | None = None) -> DataFrame:
    """Rows with their QC flag set from the contract."""
    marked = rule_flags(stream.drop("qc_flag"), rules)
    return marked.withColumnRenamed("rule_reason", "qc_flag").drop("rule_flag")


def anomalies(
    stream: DataFrame, forest: IsolationForest, source_table: str, rules: Mapping | None = None, id_col: str = "id"
) -> DataFrame:
    """Verdicts of a fitted forest in the shape of the anomaly table."""
    return anomaly_rows(check_anomalies(stream, forest, rules), source_table, id_col)


def append(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False, **trigger: str) -> StreamingQuery:
    """Append a row-wise stream to Parquet files; ``available_now`` drains the input and stops."""
    when = {"availableNow": True} if available_now else (trigger or {"processingTime": "1 minute"})
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**when)
        .start()
    )
