"""The corpus pipeline: from documents to a mix for training.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it has kept; ``run`` writes what a stage
returns as Parquet and reads it for the next one. All but the last return rows with the columns of the documents.

Defined results: the stages take over those of their operators: null texts pass all filters and get no words in the mix;
an empty table gives an empty mix; extra columns pass through to the last stage, which has columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from monsoon.llm import decontamination, line_dedup, mixing, near_duplicates, toxicity
from monsoon.llm.common import table
from monsoon.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go; it learns from the labels of this input."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has too are cut; documents that lose every word go."""
    return line_dedup.drop_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return near_duplicates.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half or more of a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "shard", "first_word")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_duplicate_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn, align and hash in ways that SQL can't express; the tests compare them with brute force.
ORACLE_SQL = None
