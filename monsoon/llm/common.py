"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters outside these six ASCII blanks.
BLANKS = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(text_or_empty(text), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once.

    A column that a lambda function of ``body`` names would be evaluated for every element as soon as the optimizer
    puts its expression in its place, for example when it pushes a filter down.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(*cols: Column) -> Column:
    """A never-null number for a row: rows equal in these columns share it."""
    return F.xxhash64(*cols)


def broadcast_if_small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Hint a broadcast for a side whose counted rows are few; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if rows <= max_rows else df
