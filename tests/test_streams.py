"""Streams that write every batch once, stored search trees, and counted appends beside model scoring."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from monsoon.operators.nearest import Pyramid, nearest_join
from monsoon.sources import sinks
from monsoon.streaming import once

SCORED = "id long, predicted string, ref_month int, ref_year int, lat double, lon double"


def scored(spark, ids, month=3):
    rows = [(i, f"class {i % 3}", month, 2020, float(i), 1.0) for i in ids]
    return spark.createDataFrame(rows, SCORED).withColumns({"use_case": F.lit("UC1"), "model_version": F.lit("1.10"), "target": F.lit("t")})


def stored_ids(spark, path):
    return sorted(r[0] for r in once.stored_batches(spark, path).select("source_id").collect())


def start(spark, root, frame, **more):
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = once.write_once(stream, f"{root}/out", f"{root}/checkpoint", "s", ["id"], available_now=True, **more)
    query.awaitTermination()


@pytest.mark.parametrize("unique", [True, False])
def test_a_batch_whose_commit_is_lost_is_played_again_and_adds_nothing(spark, tmp_path, unique):
    frame = scored(spark, range(40))
    frame.repartition(4, "id").write.parquet(f"{tmp_path}/in")
    start(spark, tmp_path, frame, unique=unique)
    assert stored_ids(spark, f"{tmp_path}/out") == list(range(40))
    files = sorted(p.name for p in Path(tmp_path, "out").rglob("part-*"))
    commits = sorted((p for p in Path(tmp_path, "checkpoint/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    assert len(commits) == 4
    # The driver was lost between the last batch's write and its commit.
    commits[-1].unlink()
    Path(commits[-1].parent, f".{commits[-1].name}.crc").unlink(missing_ok=True)
    start(spark, tmp_path, frame, unique=unique)
    assert stored_ids(spark, f"{tmp_path}/out") == list(range(40))
    assert sorted(p.name for p in Path(tmp_path, "out").rglob("part-*")) != files  # it did run again


def test_keys_of_earlier_batches_are_left_out(spark, tmp_path):
    path = f"{tmp_path}/out"
    once.prediction_batch(scored(spark, [1, 2, 2]), path, "s", 0, ["predicted"])
    once.prediction_batch(scored(spark, [2, 3]), path, "s", 1, ["predicted"])
    once.prediction_batch(scored(spark, [3, 4]), path, "other", 0, ["predicted"])
    assert stored_ids(spark, path) == [1, 2, 3, 4]
    # A replay of the first batch sees neither itself nor what came later in its stream.
    once.prediction_batch(scored(spark, [1, 2, 2]), path, "s", 0, ["predicted"])
    assert stored_ids(spark, path) == [1, 2, 3, 4]


def test_rows_without_a_key_and_empty_batches(spark, tmp_path):
    path = f"{tmp_path}/out"
    loose = scored(spark, [1, 1]).withColumns({"source_id": F.lit(None).cast("long"), "ref_month": F.lit(None).cast("int")})
    assert once.stored_batches(spark, path) is None
    for _ in range(2):
        once.prediction_batch(loose, path, "s", 0, ["id"])
    assert once.stored_batches(spark, path).count() == 2
    once.prediction_batch(scored(spark, []), path, "s", 1, ["id"])
    assert once.stored_batches(spark, path).count() == 2


def points(spark, seed, count):
    draw = random.Random(seed)
    rows = [(i, round(draw.uniform(-3, 3), 1), draw.choice([0.0, -0.0, draw.uniform(-9, 9)])) for i in range(count)]
    return spark.createDataFrame([*rows, (count, None, 1.0), (count + 1, 1.0, float("nan"))], "id long, lat double, lon double")


def test_a_stored_tree_gives_what_the_join_gives(spark, tmp_path):
    right, left = points(spark, 1, 700), points(spark, 2, 150)
    Pyramid.build(right, {"found": "id"}, ["id"], f"{tmp_path}/version=1")
    want = nearest_join(left, right, {"found": "id"}, ["id"], distance_col="d2")
    for part in (left, left.filter("id < 20"), left.limit(0)):
        tree = Pyramid(spark, f"{tmp_path}/version=1")
        got = {r["id"]: (r["found"], r["d2"]) for r in tree.join(part, distance_col="d2").collect()}
        assert got == {r["id"]: (r["found"], r["d2"]) for r in want.collect() if r["id"] in got}
        assert len(got) == part.count()
    empty = Pyramid.build(right.limit(0), {"found": "id"}, ["id"], f"{tmp_path}/version=2")
    rows = empty.join(left, distance_col="d2").collect()
    assert len(rows) == left.count() and all(r["found"] is None and r["d2"] is None for r in rows)


def test_a_stream_meets_the_stored_tree(spark, tmp_path):
    right, left = points(spark, 3, 300), points(spark, 4, 60)
    Pyramid.build(right, {"found": "id"}, ["id"], f"{tmp_path}/tree")
    left.repartition(3, "id").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(left.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def batch(rows, number):
        once.write_batch(Pyramid(spark, f"{tmp_path}/tree").join(rows), f"{tmp_path}/out", "n", number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    want = nearest_join(left, right, {"found": "id"}, ["id"]).select("id", "found").collect()
    got = spark.read.parquet(f"{tmp_path}/out").select("id", "found").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_forest_scores_after_a_counted_append(spark, tmp_path):
    """Two classes: their training summary holds the session, which an observed write would make unfit for tasks."""
    assert sinks.write_predictions(scored(spark, range(9)), f"{tmp_path}/p") == 9
    assert sinks.write_anomalies(scored(spark, range(5)).withColumn("is_anomaly", F.lit(True)), f"{tmp_path}/a", "t") == 5
    data = VectorAssembler(inputCols=["lat", "lon"], outputCol="features").transform(scored(spark, range(60)))
    data = data.withColumn("label", (F.col("id") % 2).cast("double"))
    model = RandomForestClassifier(numTrees=3, seed=1).fit(data)
    assert model.transform(data).select("prediction").collect()
