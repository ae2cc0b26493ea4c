"""Loads, roll-ups, risk, sinks, jobs and streams on small literal tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from monsoon.operators import climatology, isolation, risk, weather
from monsoon.plans import jobs
from monsoon.sources import sinks, tables
from monsoon.sources.config import load_config, load_contract, model_config
from monsoon.sources.tables import Catalog
from monsoon.streaming import rowwise
from tests.conftest import N_WEATHER, rows

# ---------------------------------------------------------------- loads


def test_parquet_source_with_geometry_nan_and_sentinel(spark, tmp_path):
    raw = spark.createDataFrame(
        [(1, "POINT(110.3 -7.8)", float("nan"), 5), (2, None, -999.0, 6), (3, "POINT (1 2)", 7.5, 7)],
        "id int, geom string, precipitation_mm double, month int",
    )
    raw.write.parquet(str(tmp_path / "chirps_monthly"))
    got = rows(Catalog(spark, root=str(tmp_path), sentinel=-999.0).chirps().orderBy("id"))
    assert got[0] == {"id": 1, "year": None, "month": 5, "precipitation_mm": None, "qc_flag": None, "lat": -7.8, "lon": 110.3}
    assert got[1]["precipitation_mm"] is None and got[1]["lat"] is None and got[2]["precipitation_mm"] == 7.5
    kept = Catalog(spark, root=str(tmp_path)).chirps().filter("id = 2").first()
    assert kept["precipitation_mm"] == -999.0
    with pytest.raises(ValueError, match="unknown source kind"):
        Catalog(spark, "csv").chirps()
    with pytest.raises(Exception, match="(?i)path"):
        Catalog(spark, root=str(tmp_path)).bmkg()


def test_json_source(spark, tmp_path):
    zone = {
        "id": 0, "kota": "Kota", "kecamatan": "Kraton", "kelurahan": None, "kode_zona": "K.1", "nama_zona": "Z",
        "kategori_zona": "Komersial", "luas_ha": 140.0, "sumber_data": "x",
        "geom_wkt": "POLYGON((110.357 -7.81, 110.367 -7.81, 110.367 -7.8, 110.357 -7.8, 110.357 -7.81))",
    }
    ready = {**zone, "id": 1, "centroid_lat": -7.5, "centroid_lon": 110.0}
    (tmp_path / "rdtr_pola_ruang.json").write_text(json.dumps([zone, ready], indent=2))
    got = rows(Catalog(spark, "json", str(tmp_path)).rdtr().orderBy("id"))
    assert got[0]["centroid_lat"] == pytest.approx(-7.805) and got[0]["centroid_lon"] == pytest.approx(110.362)
    assert got[1]["centroid_lat"] == -7.5 and got[1]["kelurahan"] is None
    (tmp_path / "qc_log.json").write_text(json.dumps([{"source": "bmkg", "total_rows": 336, "pct_clean": 99.1}]))
    assert Catalog(spark, "json", str(tmp_path)).qc_log().first()["total_rows"] == 336


def test_grid_falls_back_to_land_grid(spark):
    land = spark.createDataFrame([(1, 2023, 1, 25.0, 0.1, 24.0, 0.3, -5.0, 110.0)], tables.ERA5_LAND.schema)
    grid = spark.createDataFrame([(9, 2023, 1, 300.15, 27.0, -5.0, 110.0)], tables.ERA5.schema)
    got = Catalog(spark).era5(grid.limit(0), land).first()
    assert got["t2m_kelvin"] == 298.15 and got["soil_temp_c"] == 24.0 and got["precip_m"] == 0.1
    assert Catalog(spark).era5(grid, land).first()["id"] == 9


def test_disasters_are_clean_and_ordered(spark):
    df = spark.createDataFrame(
        [("b", "B", "x", 2011, 1, "OK", 0.0, 0.0), ("a", "A", "x", 2012, 2, None, 0.0, 0.0), ("a", "A", "x", 2010, 3, "BAD", 0.0, 0.0),
         ("a", "A", "x", 2011, 4, "OK", 0.0, 0.0)],
        tables.DISASTER.schema,
    )
    assert [(r["kode_wilayah"], r["year"]) for r in rows(Catalog(spark).bnpb_disaster(df))] == [("a", 2011), ("a", 2012), ("b", 2011)]


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"contract": {"t2m": {"min": 0, "max": 1}}, "target": "prectotcorr"}')
    assert load_contract(str(tmp_path / "c.json")) == {"t2m": {"min": 0, "max": 1}}
    assert model_config("uc2", str(tmp_path / "c.json"))["target"] == "prectotcorr"
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("contract:\n  t2m: {min: -50, max: 60}\n")
    assert load_config(str(tmp_path / "c.yaml"))["contract"]["t2m"]["max"] == 60


# ---------------------------------------------------------------- roll-ups


def _obs(spark, data):
    """(id, label, province, year, month, t2m, rain)"""
    wide = [(i, lab, p, y, m, t, t, t, 20.0, 70.0, 2.0, r, "OK", -5.0 - i, 110.0) for i, lab, p, y, m, t, r in data]
    return Catalog(spark).nasa_power(spark.createDataFrame(wide, tables.NASA.schema))


@pytest.fixture(scope="module")
def obs(spark):
    return _obs(
        spark,
        [
            (3, "Solo", "Jawa", 2022, 2, 25.25, 1.0), (1, "Solo", "Jawa", 2022, 1, 24.0, None),
            (2, "Solo", "Jawa", 2023, 1, 25.0, 3.0), (4, "Bima", "NTB", 2023, 12, 30.0, 4.0), (5, None, "NTB", 2023, 1, 1.0, 1.0),
        ],
    )


def test_series_is_in_calendar_order(obs):
    got = rows(climatology.station_series(obs, "JAWA"))
    assert len(got) == 1 and got[0]["label"] == "Solo" and got[0]["lat"] == -6.0
    # monthly means 24.5 and 25.25, whose mean is 24.875
    assert got[0]["normal_t2m"] == 24.9
    assert [s["month"] for s in got[0]["series"]] == ["Jan", "Feb"]
    assert [s["t2m"] for s in got[0]["series"]] == [24.5, 25.2]
    assert [s["precip"] for s in got[0]["series"]] == [3.0, 1.0]
    with pytest.raises(LookupError):
        climatology.station_series(obs, "Bali")


def test_location_series_and_years(obs):
    one = rows(climatology.location_series(obs, "SOLO", 2022))[0]
    assert one["year"] == 2022 and [s["t2m"] for s in one["series"]] == [24.0, 25.2]
    with pytest.raises(LookupError, match="2020"):
        climatology.location_series(obs, "solo", 2020)
    assert [r["year"] for r in rows(climatology.years(obs, "solo"))] == [2022, 2023]
    assert len(rows(climatology.location_series(obs))) == 2
    assert {r["label"]: r["lat"] for r in rows(climatology.locations(obs))} == {"Solo": -7.0, "Bima": -9.0}


def test_annual_sum_of_nothing_is_zero(spark):
    got = rows(climatology.annual(_obs(spark, [(1, "A", "P", 2020, 1, 20.0, None), (2, "A", "P", 2020, 2, 21.0, None)]), "a"))
    assert got == [{"location_label": "A", "year": 2020, "t2m": 20.5, "precip": 0.0, "rh": 70.0, "wind": 2.0, "rad": 20.0}]


def test_sample_climate_ignores_filters_without_match(obs):
    got = climatology.sample_climate(obs, "solo", 1).first()
    assert (got["location_label"], got["month"], got["lat"]) == ("Solo", 1, -6.5)
    missing = climatology.sample_climate(obs, "solo", 7).first()
    assert missing["month"] == 7 and missing["lat"] == -7.0
    assert climatology.sample_climate(obs, "nowhere").first()["lat"] == -8.0


def test_province_features_take_first_known_position(spark):
    o = _obs(spark, [(2, "A", "Jawa Barat", 2020, 7, 20.0, 1.0), (1, "A", "Jawa Barat", 2021, 7, 22.0, 1.0)])
    o = o.withColumn("lat", F.when(F.col("id") == 2, F.col("lat")))
    got = rows(climatology.province_features(o, "jabar", 7))
    assert got[0]["lat"] == -7.0 and got[0]["rh2m"] == 70.0
    for bad, error in ((0, ValueError), (13, ValueError), (8, LookupError)):
        with pytest.raises(error):
            climatology.province_features(o, "jabar", bad)


@pytest.fixture(scope="module")
def daily(spark):
    data = [
        (1, "s1", "One", "2023-01-02", 30.25, 20.0, 25.0, 1.0, "OK", -6.0, 110.0),
        (2, "s1", "One", "2023-01-01", 31.0, None, 26.0, 2.0, "RANGE:x=1", -6.0, 110.0),
        (3, "s1", "One", "2023-01-03", 40.0, 10.0, None, 9.0, "OK", -6.0, 110.0),
        (4, "s2", "Two", "2023-02-01", 33.0, 22.0, 27.0, None, None, -9.0, 111.0),
    ]
    return spark.createDataFrame(data, tables.GHCN.schema)


def test_days_without_mean_do_not_count_in_the_month(daily):
    got = rows(climatology.daily_to_monthly(daily))
    assert [(r["location_label"], r["month"], r["t2m"], r["t2m_max"], r["t2m_min"], r["prectotcorr"], r["qc_flag"]) for r in got] == [
        ("s1", 1, 25.5, 31.0, 20.0, 3.0, "OK"), ("s2", 2, 27.0, 33.0, 22.0, None, None),
    ]


def test_daily_records_of_nearest_station(obs, daily):
    got = rows(climatology.station_daily(obs, daily, "solo", 2023, 1))
    assert [r["date"] for r in got] == ["2023-01-01", "2023-01-02", "2023-01-03"]
    assert got[0]["station_dist_km"] == 0.0 and got[0]["tmin"] is None and got[1]["tmax"] == 30.2 and got[2]["tavg"] is None
    # Bima at (-9, 110) is one degree from the second station
    assert rows(climatology.nearest_stations(obs, daily, "bima"))[0]["station_dist_km"] == 111.0
    with pytest.raises(LookupError):
        climatology.station_daily(obs, daily, "solo", 1999)


def test_grid_status(spark):
    grid = spark.createDataFrame([(1, 2020, 1, 300.0, 27.0, -5.126, 110.0), (2, 2023, 1, 300.0, 27.0, 1.0, 111.5)], tables.ERA5.schema)
    got = climatology.grid_status(grid).first()
    assert (got["rows"], got["year_range"], got["lat_range"], got["lon_range"]) == (2, "2020–2023", "-5.13 s/d 1.00", "110.00 s/d 111.50")
    empty = climatology.grid_status(grid.limit(0)).first()
    assert not empty["available"] and empty["rows"] == 0 and empty["year_range"] is None and empty["message"]


def test_location_tree_keeps_parents_of_null_levels(spark):
    paths = [("P", "K1", "C1", "D2"), ("P", "K1", "C1", "D1"), ("P", "K1", "C2", None), ("P", "K2", None, None), ("Q", None, None, None), (None, "K", "C", "D")]
    df = spark.createDataFrame(paths * 2, "provinsi string, kotkab string, kecamatan string, desa string")
    got = {r["provinsi"]: r["regencies"] for r in rows(weather.location_tree(df))}
    assert got == {
        "P": {"K1": [{"kecamatan": "C1", "desa": ["D1", "D2"]}, {"kecamatan": "C2", "desa": []}], "K2": []},
        "Q": {},
    }


def test_sample_weather(spark, bmkg):
    placed = bmkg.withColumns({c: F.lit(c.upper()) for c in weather.LEVELS})
    mean = weather.sample_weather(placed, provinsi="PROVINSI").first()
    want = bmkg.agg(F.avg("suhu_c")).first()[0]
    assert mean["suhu_c"] == round(want, 1) and mean["datetime_local"] == bmkg.filter("id = 0").first()["datetime_local"]
    one = weather.sample_weather(placed, lat=-5.0, lon=110.0).first()
    nearest = min(bmkg.collect(), key=lambda r: (r["lat"] + 5) ** 2 + (r["lon"] - 110) ** 2)
    assert one["lat"] == round(nearest["lat"], 4) and one["actual_cuaca"] == nearest["cuaca"]
    assert weather.sample_weather(placed).first() == weather.sample_weather(placed.repartition(3)).first()
    with pytest.raises(LookupError):
        weather.sample_weather(placed, desa="none")
    with pytest.raises(TypeError):
        weather.sample_weather(placed, planet="x")


# ---------------------------------------------------------------- risk


def _coast(spark, slope):
    """Four points on a line from north to south, warmer by ``slope`` a point, in two months."""
    data = [("Maluku Utara", 1.0 - p, 127.5, m, 31.0 + slope * p, 4.0, 80.0) for p in range(4) for m in (3, 9)]
    return spark.createDataFrame(data, "provinsi string, lat double, lon double, month int, t2m_max double, prectotcorr double, rh2m double")


def _three_zones(spark):
    return spark.createDataFrame(
        [("North", "K1", "Permukiman", 12.0, 0.9, 127.4), ("Middle", "K2", "RTH", 80.0, -0.9, 127.6), ("South", "K3", "RTH", 7.0, -1.8, 127.5)],
        "nama_zona string, kecamatan string, kategori_zona string, luas_ha double, centroid_lat double, centroid_lon double",
    )


def test_equal_climate_has_no_risk(spark):
    # All three zones see 31.04 degrees after rounding to a digit, so nothing is left to scale.
    got = rows(risk.zone_risk(_three_zones(spark), _coast(spark, 0.01), "Maluku Utara"))
    assert [(r["avg_tmax"], r["risk_score"], r["risk_level"]) for r in got] == [(31.0, 0.0, "Rendah")] * 3


def test_zone_risk_by_hand(spark):
    """Zones take the points at 1, -1 and -2 degrees: 31, 33 and 34 degrees scale to 0, 2/3 and 1; heat weighs a half."""
    got = rows(risk.zone_risk(_three_zones(spark), _coast(spark, 1.0), "Maluku Utara"))
    assert [(r["nama_zona"], r["avg_tmax"], r["risk_score"]) for r in got] == [("South", 34.0, 0.5), ("Middle", 33.0, 0.333), ("North", 31.0, 0.0)]
    with pytest.raises(ValueError, match="Bali"):
        risk.zone_risk(_three_zones(spark), _coast(spark, 1.0), "Bali")


def test_land_cover_is_optional(spark, nasa):
    assert "landcover_class" not in risk.with_land_cover(nasa, None).columns
    empty = spark.createDataFrame([], "id long, lat double, lon double, landcover_class int")
    assert "landcover_class" not in risk.with_land_cover(nasa, empty).columns


# ---------------------------------------------------------------- sinks, jobs, streams


def _scored(spark, ids):
    return spark.createDataFrame(
        [("UC1", "rf", "dev", "cuaca", "Cerah", 0.9, -5.0 - i, 110.0, i) for i in ids],
        "use_case string, model_name string, model_version string, target string, predicted string, proba double, lat double, lon double, id long",
    )


def test_prediction_sink(spark, tmp_path):
    path = str(tmp_path / "p")
    assert sinks.write_predictions(_scored(spark, [1, 2, 2]), path) == 3
    assert sinks.write_predictions(_scored(spark, [2, 3, 3]), path, idempotent=True, order=["id"]) == 1
    assert sinks.write_predictions(_scored(spark, [2, 3, 3]), path, idempotent=True, order=["id"]) == 0
    with pytest.raises(ValueError, match="order"):
        sinks.write_predictions(_scored(spark, [9]), path, idempotent=True)
    stored = spark.read.parquet(path)
    assert stored.count() == 4 and set(sinks.PREDICTION_COLUMNS) == set(stored.columns)
    assert stored.filter("geom = 'POINT (110.0 -8.0)'").count() == 1
    assert (tmp_path / "p" / "use_case=UC1" / "model_version=dev").exists()


def test_versions_are_text_and_rows_stay_apart(spark, tmp_path):
    path = str(tmp_path / "p")
    for version in ("1.1", "1.10", "2"):
        scored = _scored(spark, range(40)).withColumn("model_version", F.lit(version)).withColumn("lat", F.lit(-5.0))
        assert sinks.write_predictions(scored, path, idempotent=True, order=["id"]) == 40
        assert sinks.write_predictions(scored, path, idempotent=True, order=["id"]) == 0
    stored = sinks.stored_predictions(spark, path)
    assert {r[0] for r in stored.select("model_version").distinct().collect()} == {"1.1", "1.10", "2"}
    # Rows that nothing tells apart aren't repeats of each other.
    nameless = _scored(spark, range(30)).withColumn("lat", F.lit(-5.0)).withColumnRenamed("id", "n")
    assert sinks.write_predictions(nameless, path, idempotent=True, order=["n"]) == 30
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|malformed"):
        sinks.write_predictions(_scored(spark, [1]), str(tmp_path / "broken"), idempotent=True, order=["id"])


def test_first_row_of_a_key_counts(spark):
    new = spark.createDataFrame([(None, "b", 2), (None, "a", 1), (1, "c", 3)], "k int, v string, id int")
    got = rows(sinks.rows_to_append(new, new.filter("k = 1"), ["k"], ["id"]))
    assert got == [{"k": None, "v": "a", "id": 1}]


def test_chain_from_files_to_predictions(spark, bmkg, tmp_path):
    bmkg.write.parquet(str(tmp_path / "bmkg_forecast"))
    (tmp_path / "cfg.json").write_text(json.dumps({"hyperparameters": {"n_estimators": 3, "max_depth": 4}, "cv": {"n_splits": 2}}))
    common = ["--root", str(tmp_path), "--model-dir", str(tmp_path / "m"), "--out", str(tmp_path / "out")]
    assert jobs.main(["chain", "--config", str(tmp_path / "cfg.json"), *common], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == N_WEATHER
    assert jobs.main(["predict", "--idempotent", *common], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == N_WEATHER
    assert jobs.main(["train", "--use-case", "uc3", *common], spark) == 0
    assert jobs.main(["predict", "--use-case", "UC3", *common[:4], "--out", str(tmp_path / "anomalies")], spark) == 0
    found = spark.read.parquet(str(tmp_path / "anomalies"))
    assert found.count() == N_WEATHER and found.filter("is_anomaly").count() >= 12
    with pytest.raises(SystemExit):
        jobs.main(["train", "--use-case", "UC9", *common], spark)


def test_stream_gives_the_batch_verdicts(spark, bmkg, tmp_path):
    planted = bmkg.withColumn("suhu_c", F.when(F.col("id") == 7, 99.0).otherwise(F.col("suhu_c")))
    planted.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(planted.schema).parquet(str(tmp_path / "in"))
    flagged = rowwise.flagged(stream)
    rowwise.append(flagged, str(tmp_path / "flags"), str(tmp_path / "c1"), available_now=True).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "flags"))
    assert out.count() == N_WEATHER and rows(out.filter("qc_flag != 'OK'").select("id", "qc_flag")) == [{"id": 7, "qc_flag": "RANGE:suhu_c=99"}]
    forest = isolation.fit_forest(planted, isolation.ANOMALY_FEATURES, trees=10)
    verdicts = rowwise.anomalies(stream, forest, "bmkg_forecast")
    rowwise.append(verdicts, str(tmp_path / "anomalies"), str(tmp_path / "c2"), available_now=True).awaitTermination(120)
    got = {r["source_id"]: (r["is_anomaly"], r["reason"]) for r in rows(spark.read.parquet(str(tmp_path / "anomalies")))}
    batch = isolation.detect_anomalies(planted, forest=forest)
    assert got == {r["id"]: (r["is_anomaly"], r["reason"]) for r in rows(batch)}


def test_location_nodes_count_what_lies_under_them(spark):
    paths = [
        ("A", "r1", "d1", "v1"), ("A", "r1", "d1", "v2"), ("A", "r1", "d2", None), ("A", "r2", None, "v9"), ("A", None, "d9", "v9"),
        ("B", None, None, None), ("B", None, None, None), (None, "r", "d", "v"),
    ]
    nodes = weather.location_nodes(spark.createDataFrame(paths, ", ".join(f"{c} string" for c in weather.LEVELS)))
    got = {tuple(r[c] for c in weather.LEVELS[: r["level"]]): (r["n_regencies"], r["n_districts"], r["n_villages"]) for r in nodes.collect()}
    assert got == {
        ("A",): (4, 3, 2), ("A", "r1"): (3, 3, 2), ("A", "r1", "d1"): (2, 2, 2), ("A", "r1", "d1", "v1"): (1, 1, 1),
        ("A", "r1", "d1", "v2"): (1, 1, 1), ("A", "r1", "d2"): (1, 1, 0), ("A", "r2"): (1, 0, 0), ("B",): (0, 0, 0),
    }
    leaves = {tuple(r) for r in weather.location_paths(nodes).collect()}
    assert leaves == {
        ("A", "r1", "d1", "v1"), ("A", "r1", "d1", "v2"), ("A", "r1", "d2", None), ("A", "r2", None, None), ("B", None, None, None),
    }
