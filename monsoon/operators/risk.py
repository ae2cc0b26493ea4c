"""Climate risk of planning zones and the disaster-frequency training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monsoon.functions.labels import ZONE_RISK_WEIGHTS, zone_risk_level
from monsoon.functions.rounding import round_array, round_scalar
from monsoon.operators.contract import require_rows
from monsoon.operators.nearest import nearest_join

DISASTER_FEATURES = ["avg_t2m", "avg_tmax", "avg_precip", "avg_rh2m", "lat", "lon"]
DISASTER_TARGET = "avg_kejadian_per_tahun"
_ZONE_DIGITS = {"avg_tmax": 1, "avg_precip": 2, "avg_humidity": 0}


def min_max(df: DataFrame, columns: list[str], suffix: str = "_scaled") -> DataFrame:
    """Add each column scaled to 0..1 over the whole frame; a constant column gives 0.

    The extremes come from one scalar subquery held in a column of its own, so it is planned once
    and no row leaves its partition.
    """
    ends = [F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]
    held = df.withColumn("__ends", df.agg(F.struct(*ends).alias("s")).scalar())

    def scaled(c: str) -> Column:
        low, high = F.col(f"__ends.{c}.lo"), F.col(f"__ends.{c}.hi")
        return F.when(high == low, F.lit(0.0)).otherwise((F.col(c) - low) / (high - low))

    return held.withColumns({c + suffix: scaled(c) for c in columns}).drop("__ends")


def zone_climate(zones: DataFrame, obs: DataFrame, province: str) -> DataFrame:
    """Zones with the rounded climate means of the nearest point of a province."""
    grid = obs.filter(F.col("provinsi") == province)
    require_rows(grid, f"no climate points for province '{province}'")
    points = (
        grid.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy("lat", "lon")
        .agg(
            F.avg("t2m_max").alias("avg_tmax"),
            F.avg("prectotcorr").alias("avg_precip"),
            F.avg("rh2m").alias("avg_humidity"),
        )
    )
    paired = nearest_join(
        zones, points, {c: c for c in _ZONE_DIGITS}, ["lat", "lon"], left_xy=("centroid_lat", "centroid_lon")
    )
    return paired.withColumns({c: round_scalar(F.col(c), d) for c, d in _ZONE_DIGITS.items()})


def zone_risk(zones: DataFrame, obs: DataFrame, province: str = "DI Yogyakarta") -> DataFrame:
    """Composite risk score and class per zone, highest first.

    Values are rounded before they are scaled: differences below the shown digits do not count.
    """
    climate = zone_climate(zones, obs, province)
    total = None
    for c, weight in ZONE_RISK_WEIGHTS.items():
        term = F.lit(weight) * F.col(f"{c}_scaled")
        total = term if total is None else total + term
    return (
        min_max(climate, list(ZONE_RISK_WEIGHTS))
        .withColumn("risk_score", round_array(total, 3))
        .withColumn("risk_level", zone_risk_level(F.col("risk_score")))
        .select(
            "nama_zona",
            "kecamatan",
            "kategori_zona",
            "luas_ha",
            "centroid_lat",
            "centroid_lon",
            *ZONE_RISK_WEIGHTS,
            "risk_score",
            "risk_level",
        )
        .orderBy(F.desc("risk_score"), "nama_zona")
    )


def disaster_training_set(disasters: DataFrame, obs: DataFrame) -> DataFrame:
    """Mean events per year of each region with the climate profile of the nearest location."""
    known = ["location_label", "lat", "lon"]
    profile = (
        obs.dropna(subset=known)
        .groupBy(*known)
        .agg(
            F.avg("t2m").alias("avg_t2m"),
            F.avg("t2m_max").alias("avg_tmax"),
            F.avg("prectotcorr").alias("avg_precip"),
            F.avg("rh2m").alias("avg_rh2m"),
        )
    )
    region = ["kode_wilayah", "nama_wilayah", "lat", "lon"]
    frequency = disasters.dropna(subset=region).groupBy(*region).agg(F.avg("jumlah_kejadian").alias(DISASTER_TARGET))
    payload = {c: c for c in ("avg_t2m", "avg_tmax", "avg_precip", "avg_rh2m")}
    return nearest_join(
        frequency, profile, {**payload, "nearest_climate": "location_label"}, ["location_label", "lat", "lon"]
    )


def with_land_cover(df: DataFrame, cover: DataFrame | None) -> DataFrame:
    """Land-cover class of the nearest cover point; without cover points the frame is unchanged."""
    if cover is None or cover.isEmpty():
        return df
    return nearest_join(df, cover, {"landcover_class": "landcover_class"}, ["id"])
