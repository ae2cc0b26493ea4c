"""Contract, order statistics, folds, metrics, nearest joins."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from monsoon.operators import contract, folds, metrics, order_stats
from monsoon.operators.joins import lookup_join
from monsoon.operators.nearest import nearest_join, nearest_record
from tests.conftest import rows

RULES = {"depth_m": {"min": 0, "max": 11000}, "salt": {"min": 2.5, "max": 41}, "min_rows_for_training": 12}

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


# ---------------------------------------------------------------- contract


def test_qc_clean(spark):
    flags = ["OK", None, "RANGE:salt=50", "ok", "RANGE:depth_m=-3|RANGE:salt=0", "OK"]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "id int, qc_flag string")
    assert [r["id"] for r in rows(contract.qc_clean(df))] == [0, 1, 5]
    assert contract.qc_clean(df.drop("qc_flag")).count() == len(flags)


def test_ranges(spark):
    water = spark.createDataFrame([(10.0, 35.0), (0.0, 2.5), (11000.5, 41.0), (-0.5, None), (12.0, 2.4)], "depth_m double, salt double")
    got = {r["column"]: (r["n_bad"], r["ok"]) for r in rows(contract.range_violations(water, RULES))}
    assert got == {"depth_m": (2, False), "salt": (1, False)}
    with pytest.raises(contract.ContractError, match="depth_m: 2 values"):
        contract.require_ranges(water, RULES)
    contract.require_ranges(water.filter("salt >= 2.5 and depth_m <= 11000"), RULES)  # the limits themselves are fine
    assert contract.range_violations(water.select(F.lit("x").alias("other")), RULES).isEmpty()
    whole = spark.createDataFrame([(7, 99)], "depth_m int, salt int")
    with pytest.raises(ValueError, match="salt"):
        contract.require_ranges(whole, RULES)


def test_min_rows(spark):
    contract.require_min_rows(spark.range(12), RULES)
    with pytest.raises(contract.ContractError, match="12"):
        contract.require_min_rows(spark.range(11), RULES)


def test_rule_flags_name_every_broken_rule(spark):
    water = [(1, 10.0, 35.0), (2, -2.5, 35.0), (3, 20000.0, 0.0), (4, None, 41.5), (5, None, None)]
    df = spark.createDataFrame(water, "id int, depth_m double, salt double")
    got = {r["id"]: (r["rule_flag"], r["rule_reason"]) for r in rows(contract.rule_flags(df, RULES))}
    assert got == {
        1: (False, "OK"), 2: (True, "RANGE:depth_m=-2.5"), 3: (True, "RANGE:depth_m=20000|RANGE:salt=0"),
        4: (True, "RANGE:salt=41.5"), 5: (False, "OK"),
    }
    assert not contract.rule_flags(df.select("id"), RULES).filter("rule_flag").count()


def test_split_valid_and_defaults(spark):
    df = spark.createDataFrame([(1, -5.0, 110.0, 13), (2, -5.0, 110.0, 7), (3, None, 200.0, 1)], "id int, lat double, lon double, month int")
    good, bad = contract.split_valid(df, contract.GRID_DOMAIN)
    assert [r["id"] for r in rows(good)] == [2]
    assert {r["id"]: r["broken"] for r in rows(bad)} == {1: ["month"], 3: ["lat", "lon"]}
    filled = rows(contract.with_defaults(df.withColumn("ws2m", F.lit(None).cast("double")), contract.CLIMATE_DEFAULTS))[0]
    assert (filled["rh2m"], filled["ws2m"], filled["allsky_sfc_sw_dwn"]) == (80.0, 2.0, 20.0)


def test_qc_log(spark):
    df = spark.createDataFrame([("a", "OK")] * 333 + [("a", "RANGE:suhu_c=99")] * 3 + [("b", None)] * 2, "src string, qc_flag string")
    got = {r["source"]: r for r in rows(contract.qc_log(df, F.col("src")))}
    assert (got["a"]["total_rows"], got["a"]["clean_rows"], got["a"]["flagged_rows"], got["a"]["pct_clean"]) == (336, 333, 3, 99.1)
    assert got["b"]["pct_clean"] == 100.0


# ---------------------------------------------------------------- order statistics


@few
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60), st.floats(0, 1))
def test_quantile_equals_numpy(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert order_stats.quantiles(df, "x", [p])[0] == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-9)


def test_quantiles_narrow_through_hot_values_and_outliers(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1, 9000), np.full(8000, 0.25), [1e12, -1e12], rng.exponential(1e-6, 5000)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
    probs = [0.0, 0.05, 0.33, 0.5, 0.66, 0.9, 1.0]
    np.testing.assert_allclose(order_stats.quantiles(df, "x", probs), np.quantile(values, probs), rtol=1e-12)


def test_column_quantiles(spark):
    df = spark.createDataFrame([(1.0, 5, None), (2.0, 7, None), (4.0, None, None)], "a double, b int, c double")
    assert order_stats.column_quantiles(df, ["a", "b", "c"], [0.5]) == {"a": [2.0], "b": [6.0], "c": [None]}


def test_ranks_of_large_integers(spark):
    start = 2**60
    df = spark.range(start, start + 5000)
    found = order_stats.select_ranks(df, "id", {None: [0, 1, 2499, 4999]})
    assert found == {(None, r): start + r for r in (0, 1, 2499, 4999)}
    with pytest.raises(ValueError, match="rank outside"):
        order_stats.select_ranks(df, "id", {None: [5000]})


# ---------------------------------------------------------------- folds


def _fold_lists(df, k):
    got = {r["id"]: r["fold"] for r in rows(df)}
    return [sorted(i for i, f in got.items() if f == fold) for fold in range(k)]


def test_contiguous_folds(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(11)], "id long")
    assert [len(f) for f in _fold_lists(folds.contiguous_folds(df, 3, "id"), 3)] == [4, 4, 3]
    assert _fold_lists(folds.contiguous_folds(df, 3, "id"), 3)[1] == [12, 15, 18, 21]
    with pytest.raises(ValueError, match="cannot fill"):
        folds.contiguous_folds(df, 12, "id")


def test_contiguous_folds_with_ties(spark):
    df = spark.createDataFrame([(i // 4, i) for i in range(20)], "id long, v int").repartition(3)
    out = folds.contiguous_folds(df, 3, "id")
    assert out.columns == ["id", "v", "fold"]
    assert [sorted(r["v"] for r in rows(out) if r["fold"] == f) for f in range(3)] == [[*range(7)], [*range(7, 14)], [*range(14, 20)]]


def test_stratified_folds_of_many_classes(spark):
    """More classes than borders are made into conditions for: the same dealing."""
    names = [f"c{i * 7 % 10_001}" for i in range(10_001)] + ["c5"] * 60 + [None] * 12
    df = spark.createDataFrame(list(enumerate(names)), "id long, c string").repartition(5)
    got = {r["id"]: r["fold"] for r in rows(folds.stratified_folds(df, 3, "c", "id"))}
    want = _dealt(names, 3)
    assert [got[i] for i in range(len(names))] == list(want)


def test_contiguous_folds_along_text(spark):
    df = spark.createDataFrame([(i, f"k{i:03d}") for i in range(20)], "id long, name string").repartition(4)
    ordered = folds.with_order_column(df, ["name"])
    assert _fold_lists(folds.contiguous_folds(ordered, 4, "row_order"), 4) == [list(range(i, i + 5)) for i in range(0, 20, 5)]


def _dealt(labels, k):
    """Stratified blocks worked out row by row."""
    seen = list(dict.fromkeys(labels))
    order = sorted(range(len(labels)), key=lambda i: (seen.index(labels[i]), i))
    share = {c: [0] * k for c in seen}
    for position, i in enumerate(order):
        share[labels[i]][position % k] += 1
    out, left = [0] * len(labels), {c: list(v) for c, v in share.items()}
    for i, c in enumerate(labels):
        fold = next(f for f in range(k) if left[c][f])
        left[c][fold] -= 1
        out[i] = fold
    return out


@few
@given(st.lists(st.sampled_from("abc"), min_size=4, max_size=40), st.integers(2, 4))
def test_stratified_folds_equal_dealing(spark, labels, k):
    df = spark.createDataFrame(list(enumerate(labels)), "id long, y string").repartition(3)
    got = {r["id"]: r["fold"] for r in rows(folds.stratified_folds(df, k, "y", "id"))}
    assert [got[i] for i in range(len(labels))] == _dealt(labels, k)


def test_hashed_folds_do_not_move(spark):
    df = spark.range(1000)
    a = rows(folds.hashed_folds(df, 5, ["id"]).orderBy("id"))
    assert a == rows(folds.hashed_folds(df.repartition(7), 5, ["id"]).orderBy("id"))
    assert len({r["fold"] for r in a}) == 5


# ---------------------------------------------------------------- metrics


def test_exact_predictions_have_the_best_scores(spark):
    named = spark.range(30).selectExpr("concat('k', id % 7) as t", "concat('k', id % 7) as p")
    assert rows(metrics.classification_metrics(named, "t", "p")) == [{"macro_f1": 1.0, "weighted_f1": 1.0}]
    numbers = spark.range(5, 25).selectExpr("id * 0.5 as t", "id * 0.5 as p")
    assert rows(metrics.regression_metrics(numbers, "t", "p")) == [{"mae": 0.0, "rmse": 0.0, "r2": 1.0}]


def test_f1_counts_labels_that_are_only_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "a")], "t string, p string")
    got = rows(metrics.classification_metrics(df, "t", "p"))[0]
    # a: 2*1/(2+2), b: 0, z: 0
    assert got["macro_f1"] == pytest.approx(0.5 / 3) and got["weighted_f1"] == pytest.approx(0.5 * 2 / 3)


def test_baselines(spark):
    data = [(0, 1.0, "x"), (0, 3.0, "y"), (1, 5.0, "y"), (1, 7.0, "x"), (1, 9.0, "x")]
    df = spark.createDataFrame(data, "fold int, v double, c string")
    assert {r["fold"]: r["prediction"] for r in rows(metrics.baseline_mean(df, "v"))} == {0: 7.0, 1: 2.0}
    # fold 1 sees one x and one y: the smaller label wins
    assert {r["fold"]: r["prediction"] for r in rows(metrics.baseline_mode(df, "c"))} == {0: "x", 1: "x"}


# ---------------------------------------------------------------- joins


def _brute(points, spots):
    out = {}
    for q, lat, lon in spots:
        best = None
        if lat is not None and lon is not None:
            best = min(
                ((plat - lat) ** 2 + (plon - lon) ** 2, pid) for pid, plat, plon in points if plat is not None
            )
        out[q] = (None, None) if best is None else (best[1], best[0])
    return out


def _both_plans(spark, points, spots):
    right = spark.createDataFrame(points, "id long, lat double, lon double")
    left = spark.createDataFrame(spots, "q long, lat double, lon double")
    for limit in (4096, 0):
        got = nearest_join(left, right, {"pid": "id"}, ["id"], distance_col="d2", max_broadcast_points=limit)
        yield {r["q"]: (r["pid"], r["d2"]) for r in rows(got)}


def test_both_nearest_plans_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    cloud = np.concatenate(
        [rng.uniform(-10, 10, (150, 2)), rng.normal(3, 1e-4, (200, 2)), np.round(rng.uniform(-10, 10, (150, 2)))]
    )
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(cloud)] + [(900, None, 1.0), (901, 2.0, 2.0), (902, 2.0, 2.0)]
    asked = np.concatenate([rng.uniform(-14, 14, (150, 2)), np.round(rng.uniform(-10, 10, (100, 2)) * 2) / 2, rng.normal(3, 1e-4, (50, 2))])
    spots = [(i, float(a), float(b)) for i, (a, b) in enumerate(asked)] + [(700 + i, 2.0, 2.0) for i in range(40)]
    spots += [(800, None, 1.0), (801, 1.0, None)]
    want = _brute(points, spots)
    for got in _both_plans(spark, points, spots):
        assert got == want


def test_nearest_with_one_or_no_point(spark):
    spots = [(1, 0.0, 0.0), (2, None, 0.0)]
    for got in _both_plans(spark, [(5, 3.0, 4.0)], spots):
        assert got == {1: (5, 25.0), 2: (None, None)}
    left = spark.createDataFrame(spots, "q long, lat double, lon double")
    none = spark.createDataFrame([], "id long, lat double, lon double")
    got = rows(nearest_join(left, none, {"pid": "id"}, ["id"], distance_col="d2"))
    assert got[0]["pid"] is None and got[0]["d2"] is None and len(got) == 2


def test_small_nearest_plan_does_not_shuffle_the_left(spark):
    left = spark.range(100).select("id", F.col("id").cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    right = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 1.0)], "pid long, lat double, lon double")
    plan = nearest_join(left, right, {"pid": "pid"}, ["pid"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "NestedLoop" not in plan


def test_nearest_record_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(3, 1.0, 0.0), (1, -1.0, 0.0), (2, None, 0.0)], "id long, lat double, lon double")
    assert nearest_record(df, 0.0, 0.0, ["id"]).first()["id"] == 1


def test_lookup_join_with_maps_and_equal_rows(spark):
    many = spark.range(200).selectExpr("id % 3 as k", "map('a', 1) as m")
    few_rows = spark.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    for limit in (1, 100):
        assert lookup_join(many, few_rows, ["k"], max_rows=limit).groupBy("v").count().orderBy("v").collect() == [("x", 67), ("y", 67)]


def test_lookup_join_plans_agree(spark):
    many = spark.range(1000).select("id", F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 20).alias("k"))
    few_rows = spark.range(15).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        a = sorted(map(tuple, lookup_join(many, few_rows, ["k"], how).collect()), key=str)
        b = sorted(map(tuple, lookup_join(many, few_rows, ["k"], how, max_rows=0).collect()), key=str)
        assert a == b
