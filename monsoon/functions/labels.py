"""Labels, classes, units and report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from monsoon.functions.rounding import round_scalar

# Risk classes and limits, weather labels, zone categories, province codes, units.
RISK_LEVELS = ("Rendah", "Sedang", "Tinggi")
ZONE_RISK_LIMITS = (-0.01, 0.33, 0.66, 1.01)
ZONE_RISK_WEIGHTS = {"avg_tmax": 0.5, "avg_precip": 0.3, "avg_humidity": 0.2}
WEATHER_ENGLISH = {
    "Cerah": "Clear Skies",
    "Cerah Berawan": "Partly Cloudy",
    "Berawan": "Mostly Cloudy",
    "Hujan Ringan": "Light Rain",
}
ZONE_CATEGORIES = {"R": "Permukiman", "K": "Komersial", "H": "RTH"}
PROVINCE_CODES = {"diy": "DI Yogyakarta", "sulsel": "Sulawesi Selatan", "jabar": "Jawa Barat"}
TEMPERATURE_UNIT, RAIN_UNIT = "°C", "mm/hari"


def zone_risk_level(score: Column) -> Column:
    """Half-open classes over the fixed limits; outside them or null gives null."""
    level = F.when((score <= ZONE_RISK_LIMITS[0]) | (score > ZONE_RISK_LIMITS[3]), F.lit(None))
    for limit, name in zip(ZONE_RISK_LIMITS[1:], RISK_LEVELS, strict=True):
        level = level.when(score <= limit, F.lit(name))
    return level


def quantile_risk_level(score: Column, q33: Column | float, q66: Column | float) -> Column:
    low, mid, high = RISK_LEVELS
    return F.when(score <= q33, F.lit(low)).when(score <= q66, F.lit(mid)).when(score.isNotNull(), F.lit(high))


def weather_label(humidity: Column, cloud: Column) -> Column:
    return (
        F.when((humidity > 85) & (cloud > 70), F.lit("Hujan Ringan"))
        .when(cloud > 50, F.lit("Berawan"))
        .when(cloud > 20, F.lit("Cerah Berawan"))
        .otherwise(F.lit("Cerah"))
    )


def weather_english(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, english in WEATHER_ENGLISH.items():
        out = F.when(label == name, F.lit(english)).otherwise(out)
    return out


def zone_category(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, category in ZONE_CATEGORIES.items():
        out = F.when(code.startswith(prefix), F.lit(category)).otherwise(out)
    return out


def province_name(code: str) -> str:
    """Full name for a short province code; anything else passes through."""
    return PROVINCE_CODES.get(code.lower(), code)


def same_text(c: Column, value: str) -> Column:
    """Case-insensitive equality."""
    return F.lower(c) == F.lower(F.lit(value))


def target_unit(target: Column) -> Column:
    return F.when(target.startswith("t2m"), F.lit(TEMPERATURE_UNIT)).otherwise(F.lit(RAIN_UNIT))


def interval(value: Column, half_width: float | None) -> tuple[Column, Column]:
    """Two-digit bounds around the unrounded value, null without a half width."""
    if half_width is None:
        missing = F.lit(None).cast("double")
        return missing, missing
    return round_scalar(value - F.lit(half_width), 2), round_scalar(value + F.lit(half_width), 2)


def skill(mae_model: Column, mae_baseline: Column) -> Column:
    return F.when(mae_baseline == 0, F.lit(0.0)).otherwise(1.0 - mae_model / mae_baseline)


def general_number(c: Column) -> Column:
    """C-style ``%g`` text: six significant digits without trailing zeros."""
    text = F.format_string("%g", c.cast("double"))
    text = F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2")
    return F.regexp_replace(text, r"\.(e|$)", "$1")
