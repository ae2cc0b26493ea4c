"""Small texts with every odd case, and the tables of the smallest scale."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
#: Extra columns have names that the operators use inside.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, node bigint, h string, "
    "lines string, score double, _t string, n bigint, item string, `at` int, root bigint, size string"
)
PAD = (1, 2, "h", "l", 0.5, "t", 3, "i", 4, 5, "s")
LONG = " ".join(f"word{i}" for i in range(30_000))


def row(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, len(text or ""), *PAD)


ODD = [
    row(1, "One short text of a few words that is alone here"),
    row(2, None),
    row(3, ""),
    row(4, " \n\t \x0b\x0c\r\n "),
    row(None, "A text without an id but with enough words to count as one"),
    row(5, LONG, "b"),
    row(6, "Same text twice in the table with the very same words in it", None),
    row(6, "Same text twice in the table with the very same words in it", None),
    row(7, "Same text twice in the table with the very same words in it", "b"),
    row(8, "ünïcödé 漢字 \U0001f600   nbsp em ퟿ text", None),
    row(9, "x" * 50_000, ""),
    row(10, "a b c"),
    row(10, "another text under an id that is taken already by three letters"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark", "conversations")}
