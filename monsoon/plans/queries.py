"""The registered queries: each operator over the climate views of the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monsoon.functions import labels, spatial, temporal, wkb
from monsoon.operators import attribution, climatology, contract, folds, isolation, metrics, order_stats, risk, weather
from monsoon.operators.nearest import Pyramid, nearest_join, nearest_record
from monsoon.plans import evaluate, score, train
from monsoon.plans.features import CLIMATE_GROUPS
from monsoon.session import cut_lineage, ensure_checkpoint_dir
from monsoon.sources import adapters, sinks
from monsoon.sources.config import model_config
from monsoon.sources.tables import Catalog
from monsoon.streaming import once, rowwise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PROVINCE = "ASIA"
LOCATION = "nation_3"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _r6(name: str):
    return F.round(name, 6).alias(name)


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog(spark).rdtr(adapters.zones(spark, sf_dir))


# ---------------------------------------------------------------- loads


@query
def load_bmkg(spark, sf_dir):
    raw = adapters.weather(spark, sf_dir)
    geom = raw.withColumn("geom", spatial.point_wkt(F.col("lat"), F.col("lon"))).drop("lat", "lon")
    return Catalog(spark).bmkg(geom).drop("kode_adm4", "datetime_utc", "cuaca_en", "qc_flag")


@query
def load_nasa_power(spark, sf_dir):
    return Catalog(spark).nasa_power(adapters.obs(spark, sf_dir))


@query
def load_chirps(spark, sf_dir):
    return Catalog(spark, sentinel=350.0).chirps(adapters.rain(spark, sf_dir))


def _zones_loaded(spark, raw):
    loaded = Catalog(spark).rdtr(raw).select(
        "id", "nama_zona", "kecamatan", "kode_zona", "kategori_zona", "luas_ha", "centroid_lat", "centroid_lon"
    )
    return loaded.withColumns(
        {"centroid_lat": F.round("centroid_lat", 9), "centroid_lon": F.round("centroid_lon", 9)}
    )


@query
def load_rdtr(spark, sf_dir):
    """Polygon centroids, next to the true centres of the squares."""
    return _zones_loaded(spark, adapters.zones(spark, sf_dir))


@query
def load_rdtr_wkb(spark, sf_dir):
    """The same zones in binary form: a square with a square hole in its middle, in a multipolygon."""
    raw = adapters.zones(spark, sf_dir)

    def ring(half):
        corners = ((-half, -half), (half, -half), (half, half), (-half, half), (-half, -half))
        return [(F.col("true_lon") + dx, F.col("true_lat") + dy) for dx, dy in corners]

    return _zones_loaded(spark, raw.withColumn("geom", wkb.multipolygon_wkb([[ring(1.0), ring(0.25)]])))


@query
def load_bmkg_wkb(spark, sf_dir):
    """Weather rows whose position is a binary point."""
    raw = adapters.weather(spark, sf_dir)
    geom = raw.withColumn("geom", wkb.point_wkb(F.col("lat"), F.col("lon"))).drop("lat", "lon")
    return Catalog(spark).bmkg(geom).drop("kode_adm4", "datetime_utc", "cuaca_en", "qc_flag")


@query
def load_era5(spark, sf_dir):
    """The coarse grid is empty here, so the land grid steps in."""
    land = adapters.land_grid(spark, sf_dir)
    empty = spark.createDataFrame([], "id long, year int, month int, t2m_celsius double, lat double, lon double")
    return Catalog(spark).era5(empty, land).withColumn("t2m_kelvin", F.round("t2m_kelvin", 6))


@query
def load_noaa_ghcn(spark, sf_dir):
    return Catalog(spark).noaa_ghcn(adapters.daily(spark, sf_dir))


@query
def load_bnpb_disaster(spark, sf_dir):
    return Catalog(spark).bnpb_disaster(adapters.disaster(spark, sf_dir))


@query
def load_worldcover(spark, sf_dir):
    return Catalog(spark).worldcover(adapters.cover(spark, sf_dir))


@query
def load_worldpop(spark, sf_dir):
    return Catalog(spark).worldpop(adapters.population(spark, sf_dir))


# ---------------------------------------------------------------- contract


@query
def contract_violations(spark, sf_dir):
    return contract.range_violations(adapters.weather(spark, sf_dir))


@query
def rule_flags(spark, sf_dir):
    flagged = contract.rule_flags(adapters.weather(spark, sf_dir))
    return flagged.select("id", "rule_flag", "rule_reason")


@query
def qc_clean(spark, sf_dir):
    return contract.qc_clean(adapters.obs(spark, sf_dir)).select("id", "qc_flag", "t2m")


@query
def qc_log(spark, sf_dir):
    obs = adapters.obs(spark, sf_dir)
    return contract.qc_log(obs, F.col("provinsi")).drop("run_timestamp")


@query
def min_rows(spark, sf_dir):
    return contract.has_min_rows(adapters.zones(spark, sf_dir))


@query
def split_valid(spark, sf_dir):
    """Accepted and rejected scoring inputs with the names of the broken fields."""
    good, bad = contract.split_valid(adapters.weather(spark, sf_dir), contract.WEATHER_DOMAIN, ("datetime_local",))
    good = good.select("id", F.lit(True).alias("valid"), F.lit("").alias("broken"))
    return good.unionByName(bad.select("id", F.lit(False).alias("valid"), F.concat_ws("|", "broken").alias("broken")))


@query
def default_fill(spark, sf_dir):
    w = adapters.weather(spark, sf_dir).withColumnRenamed("kelembaban_pct", "rh2m")
    return contract.with_defaults(w.select("id", "rh2m"), contract.CLIMATE_DEFAULTS)


# ---------------------------------------------------------------- features


@query
def temporal_features(spark, sf_dir):
    w = adapters.weather(spark, sf_dir)
    broken = F.when(F.col("id") % 23 == 0, "not a time").otherwise(F.col("datetime_local"))
    out = temporal.add_temporal_features(w.withColumn("datetime_local", broken))
    names = ["hour_sin", "hour_cos", "month_sin", "month_cos"]
    return out.select("id", "hour", "month", "musim", *[F.round(F.col(c) + 0.0, 6).alias(c) for c in names])


@query
def cyclical_wind(spark, sf_dir):
    w = spatial.add_spatial_features(adapters.weather(spark, sf_dir))
    pair = temporal.sin_cos("arah_angin_deg", 360)
    return w.select("id", "abs_lat", *pair).select(
        "id", "abs_lat", *[F.round(F.col(f"arah_angin_deg_{k}"), 6).alias(f"arah_angin_deg_{k}") for k in ("sin", "cos")]
    )


@query
def weather_label(spark, sf_dir):
    w = adapters.weather(spark, sf_dir)
    label = labels.weather_label(F.col("kelembaban_pct"), F.col("tutupan_awan_pct"))
    return w.select("id", label.alias("cuaca"), labels.weather_english(label).alias("cuaca_en"))


@query
def point_wkt(spark, sf_dir):
    z = _zones(spark, sf_dir)
    return z.select(
        "id",
        spatial.point_wkt(F.round("centroid_lat", 6), F.round("centroid_lon", 6)).alias("geom"),
        labels.zone_category(F.col("kode_zona")).alias("kategori_zona"),
    )


@query
def units_and_kelvin(spark, sf_dir):
    """Unit by target name, Celsius to kelvin, month labels."""
    o = adapters.obs(spark, sf_dir)
    target = F.when(F.col("prectotcorr").isNull(), "t2m").otherwise("prectotcorr")
    return o.select(
        "id",
        labels.target_unit(target).alias("unit"),
        F.round(F.col("t2m") + 273.15, 6).alias("t2m_kelvin"),
        temporal.month_label(F.col("month")).alias("month_label"),
    )


# ---------------------------------------------------------------- nearest points


@query
def landcover_enrich(spark, sf_dir):
    o = adapters.obs(spark, sf_dir)
    return risk.with_land_cover(o, adapters.cover(spark, sf_dir)).select("id", "landcover_class")


@query
def nearest_tree(spark, sf_dir):
    """The many-points plan: weather rows against the rain grid, distance included."""
    w = adapters.weather(spark, sf_dir)
    points = Catalog(spark).chirps(adapters.rain(spark, sf_dir))
    out = nearest_join(w, points, {"rain_id": "id"}, ["id"], distance_col="d2", max_broadcast_points=64)
    return out.select("id", "rain_id", "d2")


@query
def nearest_stations(spark, sf_dir):
    return climatology.nearest_stations(adapters.obs(spark, sf_dir), adapters.daily(spark, sf_dir))


@query
def nearest_station_daily(spark, sf_dir):
    out = climatology.station_daily(adapters.obs(spark, sf_dir), adapters.daily(spark, sf_dir))
    return out.select("location_label", "station_id", "station_dist_km", "date", "tmax", "tmin", "tavg", "prcp")


@query
def nearest_weather(spark, sf_dir):
    """The record nearest to a coordinate."""
    found = nearest_record(adapters.weather(spark, sf_dir), -6.2, 106.8, ["id"])
    return found.select("id", "desa", F.round("d2", 6).alias("d2"))


# ---------------------------------------------------------------- climatology


@query
def ghcn_monthly(spark, sf_dir):
    out = climatology.daily_to_monthly(adapters.daily(spark, sf_dir))
    return out.withColumn("t2m", F.round("t2m", 6))


@query
def monthly_climatology(spark, sf_dir):
    return climatology.monthly_table(adapters.obs(spark, sf_dir))


@query
def station_series(spark, sf_dir):
    out = climatology.station_series(adapters.obs(spark, sf_dir), PROVINCE.lower())
    return climatology.flat_series(out, ["label", "lat", "lon", "normal_t2m"])


@query
def location_series(spark, sf_dir):
    out = climatology.location_series(adapters.obs(spark, sf_dir), LOCATION, 1997)
    return climatology.flat_series(out, ["location_label", "year", "normal_t2m"])


@query
def annual_climate(spark, sf_dir):
    return climatology.annual(adapters.obs(spark, sf_dir))


@query
def years(spark, sf_dir):
    return climatology.years(adapters.obs(spark, sf_dir), LOCATION)


@query
def locations(spark, sf_dir):
    return climatology.locations(adapters.obs(spark, sf_dir))


@query
def province_features(spark, sf_dir):
    out = climatology.province_features(adapters.obs(spark, sf_dir), PROVINCE, 7)
    return out.select("label", "lat", "lon", "month", _r6("rh2m"), _r6("ws2m"), _r6("allsky_sfc_sw_dwn"))


@query
def grid_status(spark, sf_dir):
    return climatology.grid_status(Catalog(spark).era5_land(adapters.land_grid(spark, sf_dir)))


@query
def sample_climate(spark, sf_dir):
    """Both filters match, only the month matches, nothing is asked."""
    o = adapters.obs(spark, sf_dir)
    asked = [(LOCATION, 4), ("nowhere", 5), (None, None)]
    parts = [
        climatology.sample_climate(o, label, month).withColumn("asked", F.lit(f"{label}/{month}"))
        for label, month in asked
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def sample_weather(spark, sf_dir):
    return weather.sample_weather(adapters.weather(spark, sf_dir), provinsi="P1", kotkab="K6")


@query
def sample_weather_point(spark, sf_dir):
    return weather.sample_weather(adapters.weather(spark, sf_dir), lat=-3.0, lon=110.0)


@query
def sample_weather_random(spark, sf_dir):
    return weather.sample_weather(adapters.weather(spark, sf_dir))


@query
def location_hierarchy(spark, sf_dir):
    w = adapters.weather(spark, sf_dir)
    holes = w.withColumn("desa", F.when(F.col("desa") != "D7", F.col("desa")))
    return weather.location_paths(weather.location_nodes(holes))


@query
def location_levels(spark, sf_dir):
    """Every place of the hierarchy with the number of places under it."""
    w = adapters.weather(spark, sf_dir)
    holes = w.withColumns({"desa": F.when(F.col("desa") != "D7", F.col("desa")), "kotkab": F.when(F.col("id") % 5 != 0, F.col("kotkab"))})
    return weather.location_nodes(holes)


# ---------------------------------------------------------------- risk


@query
def zone_risk(spark, sf_dir):
    out = risk.zone_risk(_zones(spark, sf_dir), adapters.obs(spark, sf_dir), PROVINCE)
    return out.withColumns({c: F.round(c, 6) for c in ("centroid_lat", "centroid_lon")})


@query
def disaster_training_set(spark, sf_dir):
    disasters = Catalog(spark).bnpb_disaster(adapters.disaster(spark, sf_dir), ordered=False)
    out = risk.disaster_training_set(disasters, adapters.obs(spark, sf_dir))
    return out.select(
        "kode_wilayah",
        "nama_wilayah",
        "lat",
        "lon",
        "nearest_climate",
        *[_r6(c) for c in ("avg_t2m", "avg_tmax", "avg_precip", "avg_rh2m", risk.DISASTER_TARGET)],
    )


@query
def risk_quantiles(spark, sf_dir):
    """33rd and 66th percentile of the disaster counts and the class of every region."""
    d = adapters.disaster(spark, sf_dir)
    q33, q66 = order_stats.quantiles(d, "jumlah_kejadian", [0.33, 0.66])
    return (
        d.groupBy("kode_wilayah")
        .agg(F.avg("jumlah_kejadian").alias("m"))
        .select(
            "kode_wilayah",
            F.lit(round(q33, 6)).alias("q33"),
            F.lit(round(q66, 6)).alias("q66"),
            labels.quantile_risk_level(F.col("m"), q33, q66).alias("risk_level"),
        )
    )


# ---------------------------------------------------------------- order statistics, folds, metrics


@query
def column_medians(spark, sf_dir):
    """Medians used for imputation, next to the filled-row counts."""
    w = adapters.weather(spark, sf_dir)
    names = ["suhu_c", "kelembaban_pct", "curah_hujan_mm", "kecepatan_angin_kmh"]
    medians = order_stats.column_quantiles(w, names, [0.5])
    missing = w.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.lit(medians[c][0]).alias("median"), F.col(c).alias("n_missing")) for c in names]
    )
    return missing.select(F.inline(entries))


@query
def contiguous_folds(spark, sf_dir):
    return folds.contiguous_folds(adapters.weather(spark, sf_dir).select("id"), 5, "id")


@query
def contiguous_folds_daily(spark, sf_dir):
    """Folds along an order column with ties: rows of one id are told apart by their rain."""
    return folds.contiguous_folds(adapters.daily(spark, sf_dir).select("id", "prcp_mm"), 5, "id")


@query
def stratified_folds(spark, sf_dir):
    w = adapters.weather(spark, sf_dir).select("id", "cuaca")
    return folds.stratified_folds(w, 5, "cuaca", "id")


@query
def hashed_folds(spark, sf_dir):
    return folds.hashed_folds(adapters.weather(spark, sf_dir).select("id"), 5, ["id"])


@query
def baseline_mean(spark, sf_dir):
    o = folds.contiguous_folds(adapters.obs(spark, sf_dir), 5, "id")
    return metrics.baseline_mean(o, "t2m").withColumn("prediction", F.round("prediction", 6))


@query
def baseline_mode(spark, sf_dir):
    w = folds.stratified_folds(adapters.weather(spark, sf_dir), 5, "cuaca", "id")
    return metrics.baseline_mode(w, "cuaca")


@query
def classification_metrics(spark, sf_dir):
    pairs = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = metrics.classification_metrics(pairs, "quality", "toxic")
    return out.select(_r6("macro_f1"), _r6("weighted_f1"))


def _price_pairs(spark, sf_dir):
    l, p = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_returnflag", unit.alias("truth"), F.col("p_retailprice").alias("predicted")
    )


@query
def regression_metrics(spark, sf_dir):
    out = metrics.regression_metrics(_price_pairs(spark, sf_dir), "truth", "predicted", ["l_returnflag"])
    return out.select("l_returnflag", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query
def skill_score(spark, sf_dir):
    """Skill of the price prediction against the mean price of the whole table."""
    pairs = _price_pairs(spark, sf_dir)
    mean = pairs.agg(F.avg("truth").alias("m")).scalar()
    m = pairs.withColumn("base", mean).agg(
        F.avg(F.abs(F.col("truth") - F.col("predicted"))).alias("model"),
        F.avg(F.abs(F.col("truth") - F.col("base"))).alias("base"),
    )
    return m.select(F.round(labels.skill(F.col("model"), F.col("base")), 6).alias("skill"))


@query
def conformal_interval(spark, sf_dir):
    """Half width from out-of-fold residuals of the fold means, and the interval around each mean."""
    o = folds.contiguous_folds(adapters.obs(spark, sf_dir), 5, "id")
    base = metrics.baseline_mean(o, "t2m")
    # One row per fold: the lookup is tiny by construction.
    resid = o.join(F.broadcast(base), "fold").select(F.abs(F.col("t2m") - F.col("prediction")).alias("r"))
    q90 = round(order_stats.quantiles(resid, "r", [0.9], computed=True)[0], 4)
    low, high = labels.interval(F.col("prediction"), q90)
    return base.select("fold", F.lit(q90).alias("ci_q90"), low.alias("ci_low"), high.alias("ci_high"))


@query
def min_max_scale(spark, sf_dir):
    w = adapters.weather(spark, sf_dir).withColumn("flat", F.lit(3.0))
    names = ["suhu_c", "curah_hujan_mm", "flat"]
    return risk.min_max(w, names).select("id", *[F.round(f"{c}_scaled", 6).alias(c) for c in names])


@query
def smallest_class(spark, sf_dir):
    counts = evaluate.class_counts(adapters.weather(spark, sf_dir), "cuaca")
    return spark.createDataFrame([(min(counts.values()), len(counts))], "smallest bigint, classes bigint")


# ---------------------------------------------------------------- sinks


@query
def dedupe_append(spark, sf_dir):
    """Rows an idempotent append would add: first per key, keys already stored left out."""
    w = adapters.weather(spark, sf_dir)
    rows = w.select(
        F.lit("UC1").alias("use_case"),
        F.lit("dev").alias("model_version"),
        F.lit("cuaca").alias("target"),
        F.when(F.col("id") % 3 != 0, F.substring("datetime_local", 6, 2).cast("int")).alias("ref_month"),
        F.lit(None).cast("int").alias("ref_year"),
        spatial.point_wkt(F.col("lat"), F.col("lon")).alias("geom"),
        F.col("cuaca").alias("predicted"),
        "id",
    )
    stored = rows.filter(F.col("predicted") == "Cerah")
    # One row for each place and month: the key of a prediction without its source row.
    key = [c for c in sinks.PREDICTION_KEY if c != "source_id"]
    fresh = sinks.rows_to_append(rows.filter(F.col("predicted") != "Cerah"), stored, key, ["id"])
    return fresh.select("ref_month", "geom", "predicted", "id")


def _fresh_folder(spark, name):
    """A folder of this run beside the checkpoints, in the store that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}/{uuid.uuid4().hex}"


def _classified(spark, sf_dir, version):
    w = adapters.weather(spark, sf_dir)
    return w.select(
        F.lit("UC1").alias("use_case"), F.lit("rule").alias("model_name"), F.lit(version).alias("model_version"),
        F.lit("cuaca").alias("target"), F.col("cuaca").alias("predicted"),
        F.substring("datetime_local", 6, 2).cast("int").alias("ref_month"), "lat", "lon", "id",
    )


def _read_back(spark, path):
    stored = sinks.stored_predictions(spark, path)
    return stored.select("source_id", "model_version", "predicted", "ref_month", "geom")


@query
def append_predictions(spark, sf_dir):
    """Two plain appends of one model: every row is stored twice."""
    path = _fresh_folder(spark, "predictions")
    for _ in range(2):
        sinks.write_predictions(_classified(spark, sf_dir, "1.10"), path)
    return _read_back(spark, path)


@query
def idempotent_append(spark, sf_dir):
    """A part of version 1.1, then all of 1.1 and 1.10, and 1.1 again: one row per version and source row."""
    path = _fresh_folder(spark, "predictions")
    first = _classified(spark, sf_dir, "1.1")
    for scored in (first.filter("predicted = 'Cerah'"), first, _classified(spark, sf_dir, "1.10"), first):
        sinks.write_predictions(scored, path, idempotent=True, order=["id"])
    return _read_back(spark, path)


def _streamed(spark, rows, files, name):
    """The rows as a stream of so many files, one a batch, and folders for its checkpoint and its table."""
    root = _fresh_folder(spark, name)
    rows.repartition(files, "id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    return stream, f"{root}/checkpoint", f"{root}/out"


@query
def stream_append_once(spark, sf_dir):
    """A stream of batches, started again, and its first batch played once more: every row is stored once."""
    scored = _classified(spark, sf_dir, "1.10")
    stream, checkpoint, path = _streamed(spark, scored, 3, "streams")
    for _ in range(2):
        once.write_once(stream, path, checkpoint, "weather", ["id"], available_now=True).awaitTermination()
    first = once.stored_batches(spark, path).filter("batch = 0").select("source_id")
    replayed = cut_lineage(scored.join(first, scored["id"] == first["source_id"], "left_semi"))
    once.prediction_batch(replayed, path, "weather", 0, ["id"])
    return once.stored_batches(spark, path).select("source_id", "model_version", "predicted", "ref_month", "geom")


@query
def stream_nearest(spark, sf_dir):
    """Weather rows of a stream with their nearest rain-grid point, from a search tree that is built once."""
    points = Catalog(spark).chirps(adapters.rain(spark, sf_dir))
    rows = adapters.weather(spark, sf_dir).select("id", "lat", "lon")
    stream, checkpoint, path = _streamed(spark, rows, 2, "streams")
    Pyramid.build(points, {"rain_id": "id"}, ["id"], f"{path}-tree/version=1")

    def batch(part, number):
        tree = Pyramid(spark, f"{path}-tree/version=1")
        once.write_batch(tree.join(part, distance_col="d2"), path, "nearest", number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("id", "rain_id", "d2")


@query
def append_anomalies(spark, sf_dir):
    path = _fresh_folder(spark, "anomalies")
    flagged = contract.rule_flags(adapters.weather(spark, sf_dir))
    flagged = flagged.withColumnsRenamed({"rule_flag": "is_anomaly", "rule_reason": "reason"})
    sinks.write_anomalies(flagged, path, "bmkg_forecast")
    return spark.read.parquet(path).select("source_table", "source_id", "is_anomaly", "reason")


def _stored_bmkg(spark, sf_dir):
    raw = adapters.weather(spark, sf_dir)
    return raw.withColumn("geom", spatial.point_wkt(F.col("lat"), F.col("lon"))).drop("lat", "lon", "source")


@query
def catalog_parquet(spark, sf_dir):
    """The weather table written and read through the catalog's Parquet source."""
    root = _fresh_folder(spark, "catalog")
    _stored_bmkg(spark, sf_dir).write.parquet(f"{root}/bmkg_forecast")
    return Catalog(spark, "parquet", root).bmkg().drop("kode_adm4", "datetime_utc", "cuaca_en", "qc_flag")


@query
def catalog_json(spark, sf_dir):
    """The weather table written and read through the catalog's JSON source, one object per line."""
    root = _fresh_folder(spark, "catalog")
    _stored_bmkg(spark, sf_dir).write.json(f"{root}/bmkg_forecast.json")
    out = Catalog(spark, "json", root, json_lines=True).bmkg()
    return out.drop("kode_adm4", "datetime_utc", "cuaca_en", "qc_flag")


# ---------------------------------------------------------------- models
# Trained on whole views with fewer trees than the default settings, so that a check stays short.


def _flagged_weather(spark, sf_dir):
    """Weather rows with the QC flag the contract gives them."""
    return rowwise.flagged(adapters.weather(spark, sf_dir))


def _model_dir(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/models"


@lru_cache(maxsize=8)
def _weather_model(spark, sf_dir):
    cfg = model_config("UC1")
    cfg["hyperparameters"] = {**cfg["hyperparameters"], "n_estimators": 20, "max_depth": 8}
    return train.train_weather(_flagged_weather(spark, sf_dir), cfg, _model_dir(spark))


@lru_cache(maxsize=8)
def _climate_model(spark, sf_dir):
    cfg = model_config("UC2")
    cfg["hyperparameters"] = {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.3}
    return train.train_climate(
        adapters.obs(spark, sf_dir), cfg, adapters.cover(spark, sf_dir), _model_dir(spark)
    )


def _gate_row(spark, trained) -> DataFrame:
    about = trained.metadata
    flat = {f"model_{k}": float(v) for k, v in about["metrics"].items()}
    flat |= {f"baseline_{k}": float(v) for k, v in about["baseline_metrics"].items()}
    flat |= {"data_rows": about["data_rows"], "passed": about["quality_gate_passed"]}
    return spark.createDataFrame([tuple(flat.values())], list(flat))


@query
def weather_model_gate(spark, sf_dir):
    return _gate_row(spark, _weather_model(spark, sf_dir))


@query
def weather_prediction(spark, sf_dir):
    trained = _weather_model(spark, sf_dir)
    out = score.predict_weather(adapters.weather(spark, sf_dir), trained.model, trained.metadata)
    return out.select("id", "predicted", "proba", F.to_json("probabilities").alias("probabilities"))


@query
def weather_prediction_rows(spark, sf_dir):
    """Predictions in the shape of the result table."""
    trained = _weather_model(spark, sf_dir)
    scored = score.predict_weather_rows(_flagged_weather(spark, sf_dir), trained.model, trained.metadata)
    return sinks.prediction_rows(scored).drop("predicted_at")


@query
def weather_attribution(spark, sf_dir):
    trained = _weather_model(spark, sf_dir)
    out = score.predict_weather(
        adapters.weather(spark, sf_dir), trained.model, trained.metadata, f"{trained.artifact}/model"
    )
    return out.select("id", "predicted", F.inline_outer("shap"))


@query
def climate_model_gate(spark, sf_dir):
    return _gate_row(spark, _climate_model(spark, sf_dir))


@query
def climate_prediction(spark, sf_dir):
    trained = _climate_model(spark, sf_dir)
    asked = adapters.obs(spark, sf_dir).select("id", "lat", "lon", "month", "rh2m", "ws2m", "allsky_sfc_sw_dwn")
    out = score.predict_climate(asked, trained.model, trained.metadata, adapters.cover(spark, sf_dir))
    return out.select("id", "landcover_class", "predicted", "unit", "ci_low", "ci_high")


@query
def climate_attribution(spark, sf_dir):
    trained = _climate_model(spark, sf_dir)
    asked = adapters.obs(spark, sf_dir).select("id", "lat", "lon", "month", "rh2m", "ws2m", "allsky_sfc_sw_dwn")
    out = score.predict_climate(
        asked, trained.model, trained.metadata, adapters.cover(spark, sf_dir), f"{trained.artifact}/model"
    )
    return out.select("id", "predicted", F.inline_outer("shap"))


@query
def province_prediction(spark, sf_dir):
    trained = _climate_model(spark, sf_dir)
    obs = adapters.obs(spark, sf_dir)
    return score.predict_province(obs, trained.model, trained.metadata, PROVINCE, 7, cover=adapters.cover(spark, sf_dir))


@query
def grid_prediction(spark, sf_dir):
    """Temperature at the rain-grid points from the land-grid model."""
    cfg = model_config("UC4")
    cfg["hyperparameters"] = {"n_estimators": 10, "max_depth": 8, "min_samples_leaf": 3}
    grid = Catalog(spark).era5_land(adapters.land_grid(spark, sf_dir))
    trained = train.train_grid(grid, cfg)
    points = Catalog(spark).chirps(adapters.rain(spark, sf_dir)).select("id", "lat", "lon", "month")
    return score.predict_grid(points, trained.model, trained.metadata).drop("broken")


@query
def disaster_prediction(spark, sf_dir):
    disasters, obs = adapters.disaster(spark, sf_dir), adapters.obs(spark, sf_dir)
    disasters = Catalog(spark).bnpb_disaster(disasters, ordered=False)
    cfg = {"hyperparameters": {"n_estimators": 10, "learning_rate": 0.3}}
    trained = train.train_disaster(disasters, obs, cfg)
    return score.score_disasters(risk.disaster_training_set(disasters, obs), trained.model, trained.metadata)


@query
def anomaly_check(spark, sf_dir):
    """Forest fitted on the clean rows, verdicts for all rows."""
    trained = train.train_anomaly(_flagged_weather(spark, sf_dir))
    out = score.check_anomalies(adapters.weather(spark, sf_dir), trained.model)
    return out.select("id", "is_anomaly", "anomaly_score", "reason", "method")


@query
def climate_gate_data(spark, sf_dir):
    """What the trainer's gate compares the model with: rows, folds and errors of the means of the other folds."""
    about = _climate_model(spark, sf_dir).metadata
    base = about["baseline_metrics"]
    row = (about["data_rows"], round(base["mae"], 6), round(base["rmse"], 6))
    return spark.createDataFrame([row], "data_rows bigint, baseline_mae double, baseline_rmse double")


@query
def forest_walk(spark, sf_dir):
    """Scores of a forest of two stated trees, whose walk SQL can follow."""
    nodes = pd.DataFrame(
        [(0, 0, 0, 10.0, 1, 0.0), (0, 1, -1, 0.0, -1, 1.0), (0, 2, 1, 50.0, 3, 0.0), (0, 3, -1, 0.0, -1, 2.0),
         (0, 4, -1, 0.0, -1, 2.5), (1, 0, -1, 0.0, -1, 1.5)],
        columns=["tree", "node", "feature", "threshold", "child", "length"],
    )
    medians = {"suhu_c": 10.0, "kelembaban_pct": 60.0}
    forest = isolation.IsolationForest(list(medians), medians, nodes, 256)
    return adapters.weather(spark, sf_dir).select("id", F.round(forest.score(), 9).alias("score"))


# ---------------------------------------------------------------- baselines of the gates


@query
def weather_baseline_metrics(spark, sf_dir):
    """Macro and weighted F1 of always naming the most frequent class of the other folds."""
    w = folds.stratified_folds(adapters.weather(spark, sf_dir), 5, "cuaca", "id")
    based = w.select("fold", "cuaca").join(F.broadcast(metrics.baseline_mode(w, "cuaca")), "fold")
    out = metrics.classification_metrics(based, "cuaca", "prediction")
    return out.select(_r6("macro_f1"), _r6("weighted_f1"))


@query
def climate_baseline_metrics(spark, sf_dir):
    """mae, rmse and r2 of the mean of the other folds."""
    o = folds.contiguous_folds(adapters.obs(spark, sf_dir), 5, "id")
    based = o.select("fold", "t2m").join(F.broadcast(metrics.baseline_mean(o, "t2m")), "fold")
    out = metrics.regression_metrics(based, "t2m", "prediction")
    return out.select(_r6("mae"), _r6("rmse"), _r6("r2"))


# ---------------------------------------------------------------- result shaping


@query
def best_class(spark, sf_dir):
    """Class choice by rounded probabilities, ties to the first class."""
    w = adapters.weather(spark, sf_dir)
    parts = [(F.col("id") % m + 1).cast("double") for m in (7, 5, 3)]
    total = parts[0] + parts[1] + parts[2]
    shares = w.select("id", F.array(*[p / total for p in parts]).alias("p"))
    out = score.with_best_class(shares, F.col("p"), ["Berawan", "Cerah", "Hujan"])
    return out.select("id", "predicted", "proba")


@query
def attribution_groups(spark, sf_dir):
    """Top five display groups with their share, from one number per feature slot."""
    w = adapters.weather(spark, sf_dir)
    slots = ["kelembaban_pct", "kecepatan_angin_kmh", "tutupan_awan_pct", "lat", "lon", "arah_angin_deg", "curah_hujan_mm"]
    raw = F.array(*[F.abs(F.col(c)) for c in slots])
    out = attribution.add_top_groups(w.select("id", raw.alias("raw_slots")), "raw_slots", CLIMATE_GROUPS)
    return out.select("id", F.posexplode_outer("shap").alias("rank", "s")).select("id", "rank", "s.f", "s.w", "s.raw")
