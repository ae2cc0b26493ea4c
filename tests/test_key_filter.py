"""Key filters against the rows themselves, and the files that appends leave unopened."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from monsoon.sources import sinks
from monsoon.sources.key_filter import KeyFilter
from monsoon.streaming import once

SCORED = "id long, predicted string, ref_month int, ref_year int, lat double, lon double, use_case string, model_version string, target string"


def scored(spark, ids, version="1.10", use_case="UC1"):
    rows = [(i, f"class {i % 3}", 3, 2020, float(i % 50), 1.0, use_case, version, "t") for i in ids]
    return spark.createDataFrame(rows, SCORED)


def data_files(path):
    return sorted(p for p in Path(path).rglob("part-*.parquet") if "_keys" not in p.parts)


def spoil(files):
    """Files that can't be read any more: whoever opens one fails."""
    for file in files:
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
        file.write_bytes(b"not a table")


def key_filter(spark, path):
    return KeyFilter(sinks.stored_predictions(spark, path), path, sinks.PREDICTION_KEY, sinks.PARTITIONS)


def files_with(spark, path, ids):
    stored = sinks.stored_predictions(spark, path).filter(F.col("source_id").isin(ids))
    return {r[0] for r in stored.select("_metadata.file_path").distinct().collect()}


@pytest.mark.parametrize("version", ["1.10", "v 2/ä%20=[x]"])
def test_every_file_that_holds_a_key_is_found_and_hardly_another(spark, tmp_path, version):
    path = str(tmp_path / "p q")
    for part in range(6):
        rows = scored(spark, range(part * 100, part * 100 + 100), version)
        assert sinks.write_predictions(rows.coalesce(1), path, idempotent=True, order=["id"]) == 100
    draw = random.Random(5)
    for size in (1, 3, 40):
        ids = draw.sample(range(600), size)
        new = sinks.prediction_rows(scored(spark, ids, version))
        assert set(key_filter(spark, path).hits(new)) == files_with(spark, path, ids)
    assert key_filter(spark, path).may_hold(sinks.prediction_rows(scored(spark, range(5000, 7000), version))) is None
    assert key_filter(spark, path).may_hold(sinks.prediction_rows(scored(spark, [1], "other"))) is None
    assert key_filter(spark, path).may_hold(sinks.prediction_rows(scored(spark, [1], version)).limit(0)) is None


def test_files_without_a_key_of_the_run_stay_unopened(spark, tmp_path):
    path = str(tmp_path / "p")
    for first in (0, 100, 200):
        sinks.write_predictions(scored(spark, range(first, first + 100)).coalesce(1), path, idempotent=True, order=["id"])
    key_filter(spark, path).refresh()
    kept = {Path(f).name for f in files_with(spark, path, [150])}
    spoil(f for f in data_files(path) if f.name not in kept)
    # 150 to 199 are stored in the one file that can still be read, the others are new.
    again = scored(spark, [*range(150, 200), *range(300, 330)])
    assert sinks.write_predictions(again, path, idempotent=True, order=["id"]) == 30
    assert sinks.write_predictions(scored(spark, range(400, 500)), path, idempotent=True, order=["id"]) == 100
    with pytest.raises(Exception, match="(?i)parquet|read"):
        sinks.write_predictions(scored(spark, [5]), path, idempotent=True, order=["id"])


def test_plain_appends_and_lost_filters_are_made_up_for(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_predictions(scored(spark, [*range(50), 7, 7]).coalesce(1), path)
    assert not Path(path, "_keys").exists()
    assert sinks.write_predictions(scored(spark, range(40, 60)), path, idempotent=True, order=["id"]) == 10
    # A run ended between its filters and the note that they are whole: they are written again.
    assert key_filter(spark, path).refresh() == 1
    assert key_filter(spark, path).refresh() == 0
    Path(path, "_keys/files").rename(tmp_path / "lost")
    assert sinks.write_predictions(scored(spark, range(70)), path, idempotent=True, order=["id"]) == 10
    assert sinks.stored_predictions(spark, path).count() == 72


def test_nulls_in_a_key_equal_each_other(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = scored(spark, range(20)).withColumns({"ref_month": F.lit(None).cast("int"), "target": F.lit(None).cast("string")})
    assert sinks.write_predictions(rows, path, idempotent=True, order=["id"]) == 20
    assert sinks.write_predictions(rows, path, idempotent=True, order=["id"]) == 0
    nameless = rows.withColumn("use_case", F.lit(None).cast("string"))
    assert sinks.write_predictions(nameless, path, idempotent=True, order=["id"]) == 20
    assert sinks.write_predictions(nameless, path, idempotent=True, order=["id"]) == 0


def test_filters_of_replaced_batches_select_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    once.prediction_batch(scored(spark, range(10)), path, "s", 0, ["id"])
    once.prediction_batch(scored(spark, range(5, 20)), path, "s", 1, ["id"])
    # Batch 1 is played again with other rows, then batch 2 comes with rows that only the first attempt held.
    once.prediction_batch(scored(spark, range(12)), path, "s", 1, ["id"])
    once.prediction_batch(scored(spark, range(9, 16)), path, "s", 2, ["id"])
    stored = once.stored_batches(spark, path)
    assert sorted((r.batch, r.source_id) for r in stored.collect()) == [
        *[(0, i) for i in range(10)], (1, 10), (1, 11), *[(2, i) for i in range(12, 16)]
    ]
