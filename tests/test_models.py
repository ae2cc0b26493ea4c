"""Training, gates, stored models, scoring, attributions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from monsoon.functions.rounding import round_scalar
from monsoon.operators import attribution, isolation, risk
from monsoon.plans import evaluate, models, score, train
from monsoon.plans.features import climate_stages, weather_frame, weather_stages
from monsoon.sources.artifacts import load_artifact, load_metadata, stage_path
from tests.conftest import N_WEATHER, rows

UC1 = {
    "target": "cuaca",
    "model_name": "random_forest",
    "hyperparameters": {"n_estimators": 20, "max_depth": 8, "class_weight": "balanced"},
}
UC2 = {"target": "t2m", "model_name": "gradient_boosting", "hyperparameters": {"n_estimators": 10, "learning_rate": 0.3}}


@pytest.fixture(scope="module")
def uc1(bmkg, tmp_path_factory):
    return train.train_weather(bmkg, UC1, str(tmp_path_factory.mktemp("uc1")))


@pytest.fixture(scope="module")
def uc2(nasa, tmp_path_factory):
    return train.train_climate(nasa, UC2, model_dir=str(tmp_path_factory.mktemp("uc2")))


def test_estimator_names(spark):
    assert models.make_estimator("random_forest", n_estimators=10).getNumTrees() == 10
    assert models.make_estimator("random_forest").getMaxDepth() == 30
    assert models.make_estimator("dummy_reg") == {"strategy": "mean"}
    with pytest.raises(KeyError, match="unknown model"):
        models.make_estimator("magic")
    with pytest.raises(TypeError, match="unknown parameters"):
        models.make_estimator("random_forest", wings=2)


def test_fold_numbers():
    assert evaluate.splits_for_classes(3) == 3 and evaluate.splits_for_classes(1) == 2
    assert evaluate.splits_for_climate(12) == 3 and evaluate.splits_for_climate(1000) == 5
    assert evaluate.splits_for_interval(48) == 4 and evaluate.splits_for_interval(5) == 2
    assert evaluate.splits_for_grid(25) == 2 and evaluate.splits_for_disaster(510) == 5


def test_weather_features_have_14_slots(bmkg):
    from pyspark.ml import Pipeline

    frame = weather_frame(bmkg)
    out = Pipeline(stages=weather_stages()).fit(frame).transform(frame)
    first = out.select(vector_to_array("features").alias("f"), "arah_angin_deg", "hour", "month", "musim").first()
    assert len(first["f"]) == 14
    angle = 2 * np.pi / 360
    assert first["f"][6] == pytest.approx(np.sin(first["arah_angin_deg"] * angle))
    # hour and month use the period 360 as well, as observed
    assert first["f"][7] == pytest.approx(np.sin(first["hour"] * angle))
    assert first["f"][11] == pytest.approx(np.cos(first["month"] * angle))
    assert first["f"][12:] == ([1.0, 0.0] if first["musim"] == "basah" else [0.0, 1.0])


def test_unseen_category_is_all_zeros(nasa):
    from pyspark.ml import Pipeline

    known = nasa.withColumn("landcover_class", F.when(F.col("id") % 2 == 0, 10).otherwise(40))
    model = Pipeline(stages=climate_stages(True)).fit(known)
    out = model.transform(nasa.withColumn("landcover_class", F.lit(0))).select(vector_to_array("features").alias("f"))
    assert len(out.first()["f"]) == 9
    assert out.first()["f"][7:] == [0.0, 0.0]


def test_uc1_beats_baseline_and_is_stored(spark, uc1):
    assert uc1.metadata["quality_gate_passed"]
    assert uc1.metadata["metrics"]["macro_f1"] > uc1.metadata["baseline_metrics"]["macro_f1"] + 0.10
    assert load_metadata(spark, uc1.artifact)["classes"] == ["Angin", "Kabut", "Mendung", "Terang"]
    assert load_metadata(spark, uc1.artifact + "-absent") == {}


def test_same_metric_twice(bmkg):
    a = evaluate.evaluate_weather(bmkg, n_splits=2, hyperparameters={"n_estimators": 5, "max_depth": 5})
    b = evaluate.evaluate_weather(bmkg, n_splits=2, hyperparameters={"n_estimators": 5, "max_depth": 5})
    assert a["model"] == b["model"]


def test_stored_model_equals_model_in_memory(spark, bmkg, uc1):
    model, about = load_artifact(spark, uc1.artifact)
    stored = rows(score.predict_weather_rows(bmkg, model, about))
    direct = rows(score.predict_weather_rows(bmkg, uc1.model, uc1.metadata))
    assert stored == direct
    assert len(stored) == N_WEATHER
    assert all(0 <= r["proba"] <= 1 and r["use_case"] == "UC1" for r in stored)


def test_weather_probabilities_and_rejected_rows(spark, bmkg, uc1):
    broken = bmkg.withColumn("suhu_c", F.when(F.col("id") == 3, 99.0).otherwise(F.col("suhu_c")))
    out = rows(score.predict_weather(broken, uc1.model, uc1.metadata, f"{uc1.artifact}/model"))
    assert len(out) == N_WEATHER
    bad = [r for r in out if r["broken"]]
    assert [r["id"] for r in bad] == [3] and bad[0]["predicted"] is None and bad[0]["shap"] is None
    for r in out:
        if not r["broken"]:
            assert sum(r["probabilities"].values()) == pytest.approx(1.0, abs=1e-3)
            assert r["proba"] == max(r["probabilities"].values()) == r["probabilities"][r["predicted"]]
            assert len(r["shap"]) == 5
            weights = [s["w"] for s in r["shap"]]
            assert weights == sorted(weights, reverse=True) and sum(weights) <= 1.0001


def test_kept_inputs_give_the_same_model(spark, bmkg, nasa):
    """The rows of an ensemble are worked out once; the model is that of a plain fit of the pipeline."""
    counts = evaluate.class_counts(bmkg, "cuaca")
    labelled = models.with_balanced_weight(evaluate.with_label(weather_frame(bmkg), "cuaca", sorted(counts)), counts, "cuaca")
    labelled = evaluate.kept_for_training(labelled, N_WEATHER)
    forest = models.weather_pipeline(sorted(counts), n_estimators=4, max_depth=4, class_weight="balanced")
    boosting = models.climate_pipeline("t2m", n_estimators=3)
    for pipeline, frame in ((forest, labelled), (boosting, evaluate.kept_for_training(nasa, 60))):
        frame.count()
        stored = set(spark.sparkContext._jsc.getPersistentRDDs())
        kept = models.fit_kept(pipeline, frame)
        assert set(spark.sparkContext._jsc.getPersistentRDDs()) == stored
        plain = pipeline.fit(frame)
        columns = ["id", "predicted"]
        assert rows(kept.transform(frame).select(*columns)) == rows(plain.transform(frame).select(*columns))
        trees = [next(s for s in m.stages if hasattr(s, "toDebugString")).toDebugString.split("\n", 1)[1] for m in (kept, plain)]
        assert trees[0] == trees[1]
        frame.unpersist()


def test_large_tables_train_in_more_partitions_and_fewer_folds_at_once(bmkg):
    parts = {n: evaluate.kept_for_training(bmkg.select("id", "suhu_c"), n).rdd.getNumPartitions() for n in (None, N_WEATHER, 4_000_000, 36_000_000)}
    assert parts == {None: 8, N_WEATHER: 8, 4_000_000: 8, 36_000_000: 72}
    assert [evaluate.folds_at_once(5, n) for n in (0, N_WEATHER, 1_600_000, 4_000_000, 36_000_000)] == [5, 5, 5, 2, 1]
    assert evaluate.folds_at_once(2, N_WEATHER) == 2


def test_uc2_skill_and_highland_colder(spark, nasa, uc2):
    assert uc2.metadata["skill_score"] > 0 and uc2.metadata["quality_gate_passed"]
    assert uc2.metadata["ci_q90"] > 0
    asked = spark.createDataFrame(
        [("coast", -4.01, 119.63, 7, 80.0), ("high", -5.25, 119.92, 7, 80.0), ("off", -5.25, 119.92, 13, 80.0)],
        "name string, lat double, lon double, month int, rh2m double",
    )
    out = {r["name"]: r for r in rows(score.predict_climate(asked, uc2.model, uc2.metadata))}
    assert out["high"]["predicted"] < out["coast"]["predicted"]
    assert out["off"]["predicted"] is None and out["off"]["month"] == 13 and out["off"]["broken"] == ["month"]
    coast = out["coast"]
    assert coast["unit"] == "°C" and coast["ws2m"] == 2.0 and coast["landcover_class"] == 0
    assert coast["ci_high"] - coast["ci_low"] == pytest.approx(2 * uc2.metadata["ci_q90"], abs=0.011)


def test_uc2_with_land_cover(spark, nasa):
    cover = spark.createDataFrame(
        [(1, -5.0, 119.0, 10), (2, -3.0, 120.0, 40), (3, -7.0, 107.0, 50)], "id long, lat double, lon double, landcover_class int"
    )
    trained = train.train_climate(nasa, {**UC2, "hyperparameters": {"n_estimators": 2}}, cover)
    assert trained.metadata["use_landcover"]
    out = rows(score.predict_province(nasa, trained.model, trained.metadata, "sulsel", 7, cover=cover))
    assert [r["label"] for r in out] == ["Malino", "Palopo", "Parepare", "Rantepao"]
    assert out[0]["prov"] == "Sulawesi Selatan" and out[0]["ci_low"] < out[0]["predicted"] < out[0]["ci_high"]


def test_uc4_grid(spark):
    grid = spark.createDataFrame(
        [(i, -5.0 + (i % 10) / 4, 110.0 + (i % 7) / 4, i % 12 + 1, 30.0 - (i % 10), 25.0 - (i % 10)) for i in range(300)],
        "id long, lat double, lon double, month int, t2m_celsius double, soil_temp_c double",
    )
    cfg = {"target": "t2m_celsius", "hyperparameters": {"n_estimators": 10, "max_depth": 6, "min_samples_leaf": 3}}
    trained = train.train_grid(grid, cfg)
    assert trained.metadata["use_soil"] and trained.metadata["skill_score"] > 0.5
    points = spark.createDataFrame([(-5.0, 110.0, 1), (9.0, 110.0, 1)], "lat double, lon double, month int")
    out = rows(score.predict_grid(points, trained.model, trained.metadata))
    assert out[0]["predicted_t2m_celsius"] is not None and out[1]["predicted_t2m_celsius"] is None
    plain = train.train_grid(grid.drop("soil_temp_c"), cfg)
    assert plain.metadata["data_source"] == "era5_monthly"
    with pytest.raises(RuntimeError, match="empty"):
        train.train_grid(grid.filter("id < 0"), cfg)


def test_uc5_disaster(spark, nasa):
    disasters = spark.createDataFrame(
        [(f"{k:02d}", f"W{k}", 2010 + y, (k % 4) * 3 + y % 2, -7.0 + (k % 5), 107.0 + (k % 14)) for k in range(60) for y in range(4)],
        "kode_wilayah string, nama_wilayah string, year int, jumlah_kejadian int, lat double, lon double",
    )
    trained = train.train_disaster(disasters, nasa, {"hyperparameters": {"n_estimators": 5}})
    assert trained.metadata["q33"] <= trained.metadata["q66"] and trained.metadata["data_rows"] == 60
    features = risk.disaster_training_set(disasters, nasa)
    out = rows(score.score_disasters(features, trained.model, trained.metadata))
    assert len(out) == 60 and set(r["risk_level"] for r in out) <= {"Rendah", "Sedang", "Tinggi"}
    values = [r["predicted_kejadian"] for r in out]
    assert values == sorted(values, reverse=True)
    plain = rows(score.score_disasters(features, trained.model, {}))
    assert len(plain) == 60
    with pytest.raises(RuntimeError, match="disaster table is empty"):
        train.train_disaster(disasters.limit(0), nasa)


# ---------------------------------------------------------------- attributions


def _check_sums(spark, stage, path, transformed, predicted):
    leaves, expected = attribution.read_leaves(spark, path, stage.treeWeights)
    got = transformed.select(vector_to_array("features").alias("x"), predicted.alias("p")).collect()
    x = np.array([r["x"] for r in got])
    phi = attribution.shapley(x, leaves, len(expected))
    want = np.array([np.atleast_1d(r["p"]) for r in got])
    np.testing.assert_allclose(phi.sum(axis=1) + expected, want, atol=1e-9)
    return leaves, phi, x


def test_attributions_add_up(spark, bmkg, nasa, uc1, uc2):
    at = len(uc1.model.stages) - 2
    path = stage_path(f"{uc1.artifact}/model", uc1.model, at)
    _check_sums(spark, uc1.model.stages[at], path, uc1.model.transform(weather_frame(bmkg)), vector_to_array("probability"))
    at = len(uc2.model.stages) - 1
    path = stage_path(f"{uc2.artifact}/model", uc2.model, at)
    _check_sums(spark, uc2.model.stages[at], path, uc2.model.transform(nasa), F.col("predicted"))


def test_attribution_equals_subset_definition(spark, nasa, uc2):
    """Against the definition: average over all orders of the conditional tree expectation."""
    from itertools import combinations
    from math import factorial

    at = len(uc2.model.stages) - 1
    path = stage_path(f"{uc2.artifact}/model", uc2.model, at)
    leaves, expected = attribution.read_leaves(spark, path, uc2.model.stages[at].treeWeights)
    x = np.array(uc2.model.transform(nasa).select(vector_to_array("features").alias("x")).first()["x"])[None]
    phi = attribution.shapley(x, leaves, 1)[0, :, 0]

    def value(subset):
        total = 0.0
        for leaf in leaves:
            p = 1.0
            for f, share, tests in zip(leaf.features, leaf.shares, leaf.tests):
                p *= float(attribution._passes(x[:, f], tests)[0]) if f in subset else share
            total += p * leaf.value[0]
        return total

    n = x.shape[1]
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        want = sum(
            factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (value({*s, i}) - value(set(s)))
            for size in range(n)
            for s in combinations(rest, size)
        )
        assert phi[i] == pytest.approx(want, abs=1e-9)


def test_explainer_equals_pattern_sums(monkeypatch):
    """Random leaves with thresholds, categories and repeated features, rows with NaN: by tables, and where no table has room."""
    rng = np.random.default_rng(4)
    leaves = []
    for i in range(200):
        features = list(rng.permutation(7)[: i % 8])
        tests = []
        for f in features:
            of = lambda: (f == 6, tuple(sorted(rng.choice(4, 2, replace=False) * 1.0)) if f == 6 else (float(rng.integers(9)),), bool(rng.integers(2)))  # noqa: B023, E731
            tests.append([of() for _ in range(1 + i % 3)])
        leaves.append(attribution.Leaf(rng.normal(size=2), features, rng.uniform(0.1, 0.9, len(features)), tests))
    x = rng.integers(0, 10, (300, 8)).astype("float64")
    x[::17, 2] = np.nan
    want = np.zeros((300, 8, 2))
    for leaf in leaves:
        m = len(leaf.features)
        if m:
            hit = np.array([attribution._passes(x[:, f], tests) for f, tests in zip(leaf.features, leaf.tests)], dtype="float64")
            for j, row in enumerate(attribution._weights_of(hit, leaf.shares)):
                want[:, leaf.features[j], :] += row[:, None] * leaf.value[None, :]
    np.testing.assert_allclose(attribution.shapley(x, leaves, 2), want, atol=1e-12)
    monkeypatch.setattr(attribution, "_TABLE_NUMBERS", 500)
    monkeypatch.setattr(attribution, "_CHUNK", 64)
    explainer = attribution.Explainer(leaves, 2)
    np.testing.assert_allclose(explainer.attributions(x).transpose(2, 0, 1), want, atol=1e-12)
    assert explainer.attributions(x[:0]).shape == (8, 2, 0) and attribution.shapley(x, [], 2).shape == (300, 8, 2)


def test_roundings_of_batches_and_columns_agree(spark):
    rng = np.random.default_rng(2)
    values = [0.0, -0.0, 0.00005, 0.33335, 1.00005, -0.12345, 2.5e-7, 1.5e-6, 4.6e15, -7.1e17, float("nan"), float("inf")]
    values += [*rng.normal(size=300), *(rng.integers(-99999, 99999, 300) / 100000 + 5e-6), *(rng.integers(-9999, 9999, 300) / 10000 + 5e-5)]
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, v double")
    for digits in (4, 6):
        want = [r[0] for r in frame.orderBy("id").select(round_scalar(F.col("v"), digits)).collect()]
        got = attribution._rounded(np.array(values), digits)
        assert [repr(float(v)) for v in got] == [repr(v) for v in want]


def test_top_groups_have_no_interpreted_steps(spark):
    data = [(1, [3.0, 1.0, 2.0, 0.0]), (2, [0.0, 0.0, 0.0, 0.0]), (3, None), (4, [1.0, None, 1.0, 2.0]), (5, [0.5])]
    frame = spark.createDataFrame(data, "id int, raw array<double>")
    for top in (2, 5):
        out = attribution.add_top_groups(frame, "raw", ["a", "b", "a", "c"], top)
        got = {r["id"]: [(s["f"], s["w"], s["raw"]) for s in r["shap"]] for r in rows(out)}
        all_of = {
            1: [("a", 0.8333, 5.0), ("b", 0.1667, 1.0), ("c", 0.0, 0.0)], 2: [("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 0.0)],
            4: [("a", 0.5, 2.0), ("c", 0.5, 2.0), ("b", 0.0, 0.0)], 5: [("a", 1.0, 0.5), ("b", 0.0, 0.0), ("c", 0.0, 0.0)],
        }
        all_of[3] = all_of[2]
        assert got == {i: groups[:top] for i, groups in all_of.items()}
        assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()


def test_climate_attributions(nasa, uc2):
    out = rows(score.predict_climate(nasa, uc2.model, uc2.metadata, model_path=f"{uc2.artifact}/model"))
    assert len(out) == 60
    assert all(len(r["shap"]) == 5 and abs(r["shap"][0]["w"]) <= 1 for r in out)


# ---------------------------------------------------------------- isolation forest


def test_forest_finds_the_outliers(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (600, 2)))]
    data += [(1000 + i, 9.0 + i, -9.0 - i) for i in range(5)] + [(2000, None, 0.1)]
    df = spark.createDataFrame(data, "id long, a double, b double")
    forest = isolation.fit_forest(df, ["a", "b"], contamination=0.02)
    assert len(set(forest.nodes["tree"])) == 100 and forest.sample_size == 256
    out = rows(isolation.detect_anomalies(df, ["a", "b"], forest, contract={}))
    share = np.mean([r["is_anomaly"] for r in out])
    assert 0.015 <= share <= 0.025
    by_score = sorted(out, key=lambda r: -r["anomaly_score"])
    assert {r["id"] for r in by_score[:5]} == {1000, 1001, 1002, 1003, 1004}
    assert all(0 < r["anomaly_score"] <= 1 for r in out)
    assert all(r["reason"] == ("isolation_forest" if r["is_anomaly"] else "OK") for r in out)
    again = isolation.fit_forest(df.repartition(3), ["a", "b"], contamination=0.02)
    assert again.offset == forest.offset
    forest.save(spark, str(tmp_path / "f"))
    stored = isolation.IsolationForest.load(spark, str(tmp_path / "f"))
    assert rows(isolation.detect_anomalies(df, ["a", "b"], stored, contract={})) == out


def test_average_path_values():
    assert list(isolation.average_path([0, 1, 2])) == [0, 0, 1]
    assert float(isolation.average_path(256)) == pytest.approx(10.244770920116851)


def test_uc3_training_and_methods(spark, bmkg, tmp_path):
    trained = train.train_anomaly(bmkg, model_dir=str(tmp_path))
    forest, about = load_artifact(spark, trained.artifact)
    assert about["feature_cols"] == isolation.ANOMALY_FEATURES and about["data_rows"] == N_WEATHER
    asked = spark.createDataFrame(
        [(1, 28.0, 80.0), (2, 200.0, 80.0), (3, 200.0, -50.0)], "id long, suhu_c double, kelembaban_pct double"
    )
    out = {r["id"]: r for r in rows(score.check_anomalies(asked, forest))}
    assert out[2]["is_anomaly"] and out[2]["reason"] == "RANGE:suhu_c=200"
    assert out[3]["method"] == "both" and out[3]["reason"] == "RANGE:suhu_c=200|RANGE:kelembaban_pct=-50"
    legacy = {r["id"]: r for r in rows(score.check_anomalies(asked, forest, legacy=True))}
    assert legacy[3]["method"] == "rule"
    with pytest.raises(RuntimeError, match="none of the anomaly features"):
        train.train_anomaly(bmkg.select("id", "lat"))


def test_model_info(spark, uc1):
    info = rows(score.model_info(spark, uc1.metadata))[0]
    assert info["model_loaded"] and info["data_rows"] == N_WEATHER and info["metrics"]["macro_f1"] > 0.5
    assert not rows(score.model_info(spark, {}))[0]["model_loaded"]
