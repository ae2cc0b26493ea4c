"""Column functions against Python and hand-worked values."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from monsoon.functions import labels, rounding, spatial, temporal
from tests.conftest import rows


def test_roundings_equal_python_and_numpy(spark):
    rng = random.Random(3)
    values = [k / 100 for k in range(-3000, 3000)] + [rng.uniform(-200, 200) for _ in range(2000)]
    values += [2.5, 3.5, -2.5, 0.125, 1.005, 27.25, 27.85]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for digits in (0, 1, 2, 3, 4):
        got = df.select("x", rounding.round_scalar(F.col("x"), digits).alias("s"), rounding.round_array(F.col("x"), digits).alias("a"))
        for r in got.collect():
            assert r["s"] == round(r["x"], digits)
            assert r["a"] == float(np.round(r["x"], digits))
    assert spark.range(1).select(rounding.round_scalar(F.lit(None).cast("double"), 1)).first()[0] is None


def test_rounding_of_large_values(spark):
    values = [s * 10.0**e * 1.2345678912345 for e in (11, 12, 15, 16, 19, 30, 100, 300) for s in (1, -1)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 4):
        got = df.select(rounding.round_scalar(F.col("x"), digits).alias("s"), rounding.round_array(F.col("x"), digits).alias("a")).collect()
        assert [r["s"] for r in got] == pytest.approx([round(v, digits) for v in values], rel=1e-15)
        # Half a unit of the last digit at most, and what scaling a double up and down loses.
        assert all(abs(r["a"] - v) <= 0.5 * 10.0**-digits + abs(v) * 2**-51 for r, v in zip(got, values, strict=True))


def test_cyclic_values_join_at_the_ends(spark):
    df = spark.createDataFrame([(0,), (12,), (6,)], "month int").select("month", *temporal.sin_cos("month", 12))
    got = {r["month"]: r for r in rows(df)}
    assert got[0]["month_sin"] == pytest.approx(got[12]["month_sin"], abs=1e-12)
    assert got[0]["month_cos"] == pytest.approx(got[12]["month_cos"])
    assert got[6]["month_cos"] == pytest.approx(-1.0)


def test_temporal_features(spark):
    texts = ["2023-01-15 20:00:00", "2023-07-15T08:00:00Z", "rubbish", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, datetime_local string")
    got = {r["i"]: r for r in rows(temporal.add_temporal_features(df))}
    assert (got[0]["hour"], got[0]["month"], got[0]["musim"]) == (20, 1, "basah")
    assert (got[1]["hour"], got[1]["month"], got[1]["musim"]) == (8, 7, "kemarau")
    assert got[2]["hour"] is None and got[2]["hour_sin"] is None and got[2]["musim"] == "kemarau"
    assert got[3]["month"] is None and got[3]["musim"] == "kemarau"
    assert got[0]["hour_sin"] == pytest.approx(math.sin(2 * math.pi * 20 / 24))


def test_points_and_polygons(spark):
    shapes = [
        "POLYGON((110.355 -7.828, 110.365 -7.828, 110.365 -7.8180000000000005, 110.355 -7.8180000000000005, 110.355 -7.828))",
        "SRID=4326;MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0),(1 1, 2 1, 2 2, 1 2, 1 1)), ((10 0, 12 0, 12 2, 10 2, 10 0)))",
        "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0))",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(shapes)), "i int, g string")
    centre = df.withColumn("c", spatial.polygon_centroid(F.col("g")))
    got = {r["i"]: r for r in rows(centre.select("i", "c.lat", "c.lon"))}
    assert got[0]["lat"] == pytest.approx(-7.823, abs=1e-12) and got[0]["lon"] == pytest.approx(110.36, abs=1e-12)
    # areas 16 - 1 + 4, moments from the three squares
    assert got[1]["lon"] == pytest.approx((16 * 2 - 1.5 + 4 * 11) / 19)
    assert got[1]["lat"] == pytest.approx((16 * 2 - 1.5 + 4 * 1) / 19)
    assert (got[2]["lat"], got[2]["lon"]) == (2.0, 2.0)
    assert got[3]["lat"] is None and got[3]["lon"] is None
    point = spark.createDataFrame([("POINT(107.6 -6.9)",), ("LINESTRING(0 0, 1 1)",)], "g string")
    got = rows(point.select(spatial.point_lat(F.col("g")).alias("lat"), spatial.point_lon(F.col("g")).alias("lon")))
    assert got == [{"lat": -6.9, "lon": 107.6}, {"lat": None, "lon": None}]
    wkt = spark.range(1).select(spatial.point_wkt(F.lit(-6.9), F.lit(107.6)).alias("w")).first()["w"]
    assert wkt == "POINT (107.6 -6.9)"


def test_general_number_equals_percent_g(spark):
    values = [99.0, 1e-5, 123456789.0, 0.5, 100.0, 1e20, -3.25, 0.0, 1234567.0, 0.00012345678, 1e100, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", labels.general_number(F.col("x")).alias("g")).collect():
        assert r["g"] == f"{r['x']:g}"


def test_risk_classes(spark):
    scores = [0.0, 0.33, 0.331, 0.66, 0.661, 1.0, 1.02, -0.01, None]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = [r[0] for r in df.select(labels.zone_risk_level(F.col("s"))).collect()]
    assert got == ["Rendah", "Rendah", "Sedang", "Sedang", "Tinggi", "Tinggi", None, None, None]
    got = [r[0] for r in df.select(labels.quantile_risk_level(F.col("s"), 0.33, 0.66)).collect()]
    assert got == ["Rendah", "Rendah", "Sedang", "Sedang", "Tinggi", "Tinggi", "Tinggi", "Rendah", None]


def test_labels_units_and_codes(spark):
    df = spark.createDataFrame([(90.0, 80.0), (90.0, 60.0), (10.0, 21.0), (10.0, 20.0), (None, 80.0)], "h double, c double")
    label = labels.weather_label(F.col("h"), F.col("c"))
    got = [tuple(r) for r in df.select(label, labels.weather_english(label)).collect()]
    assert got == [
        ("Hujan Ringan", "Light Rain"), ("Berawan", "Mostly Cloudy"), ("Cerah Berawan", "Partly Cloudy"),
        ("Cerah", "Clear Skies"), ("Berawan", "Mostly Cloudy"),
    ]
    assert labels.province_name("SulSel") == "Sulawesi Selatan" and labels.province_name("Bali") == "Bali"
    one = spark.range(1).select(
        labels.target_unit(F.lit("t2m_max")).alias("a"),
        labels.target_unit(F.lit("prectotcorr")).alias("b"),
        labels.zone_category(F.lit("H.1")).alias("c"),
        labels.skill(F.lit(1.0), F.lit(2.0)).alias("s1"),
        labels.skill(F.lit(1.0), F.lit(0.0)).alias("s2"),
        labels.skill(F.lit(3.0), F.lit(2.0)).alias("s3"),
        temporal.month_label(F.lit(8)).alias("m"),
        *[c.alias(n) for c, n in zip(labels.interval(F.lit(27.234), 1.5), ("lo", "hi"))],
        *[c.alias(n) for c, n in zip(labels.interval(F.lit(27.234), None), ("nlo", "nhi"))],
    ).first()
    assert tuple(one) == ("°C", "mm/hari", "RTH", 0.5, 0.0, -0.5, "Agu", 25.73, 28.73, None, None)
