"""Lookups over the weather-forecast table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monsoon.functions.rounding import round_scalar
from monsoon.operators.contract import require_rows
from monsoon.operators.nearest import nearest_record

LEVELS = ("provinsi", "kotkab", "kecamatan", "desa")
_DIGITS = {
    "suhu_c": 1,
    "kelembaban_pct": 1,
    "kecepatan_angin_kmh": 1,
    "arah_angin_deg": 0,
    "tutupan_awan_pct": 1,
    "curah_hujan_mm": 1,
    "lat": 4,
    "lon": 4,
}


def mean_record(df: DataFrame) -> DataFrame:
    """Many rows -> one: rounded means, plus time, village and label of the first row."""
    first = F.min_by(F.struct("datetime_local", "desa", "cuaca"), "id")
    means = df.agg(*[F.avg(c).alias(c) for c in _DIGITS], first.alias("first"))
    return means.select(
        *[round_scalar(F.col(c), d).alias(c) for c, d in _DIGITS.items()],
        F.col("first.datetime_local").cast("string").alias("datetime_local"),
        F.col("first.desa").alias("desa"),
        F.col("first.cuaca").alias("actual_cuaca"),
    )


def sample_weather(
    df: DataFrame,
    lat: float | None = None,
    lon: float | None = None,
    seed: int = 42,
    **levels: str | None,
) -> DataFrame:
    """One representative record: of an administrative area, else nearest to a point, else random.

    The random row is the one with the smallest seeded hash of its id, so it is reproducible.
    """
    unknown = set(levels) - set(LEVELS)
    if unknown:
        raise TypeError(f"unknown level {sorted(unknown)}")
    chosen = {c: levels[c] for c in LEVELS if levels.get(c)}
    if chosen:
        sub = df
        for c, value in chosen.items():
            sub = sub.filter(F.col(c) == value)
        return mean_record(require_rows(sub, f"no data for {chosen}", LookupError))
    if lat is not None and lon is not None:
        return mean_record(nearest_record(df, lat, lon, ["id"]).drop("d2"))
    mixed = F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed))))
    return mean_record(df.orderBy(mixed, "id").limit(1))


def location_tree(df: DataFrame) -> DataFrame:
    """One row per province: map of regency -> [(district, [villages])], all sorted.

    A null level is left out of its list, its parent stays.
    """
    paths = df.filter(F.col("provinsi").isNotNull()).select(*LEVELS).distinct()
    villages = paths.groupBy("provinsi", "kotkab", "kecamatan").agg(
        F.sort_array(F.collect_list("desa")).alias("desa")
    )
    district = F.when(F.col("kecamatan").isNotNull(), F.struct("kecamatan", "desa"))
    districts = villages.groupBy("provinsi", "kotkab").agg(F.sort_array(F.collect_list(district)).alias("districts"))
    regency = F.when(F.col("kotkab").isNotNull(), F.struct("kotkab", "districts"))
    return districts.groupBy("provinsi").agg(
        F.map_from_entries(F.sort_array(F.collect_list(regency))).alias("regencies")
    )


def location_nodes(df: DataFrame) -> DataFrame:
    """One row per place of the hierarchy: its path (null below it), ``level`` from 1, and what lies under it.

    One rollup over the distinct paths counts all levels at once; no row or task holds the places of a whole province.
    A null level is no place, and neither is what lies under it; its parent stays.
    """
    under = {"n_regencies": "kotkab", "n_districts": "kecamatan", "n_villages": "desa"}
    paths = df.filter(F.col("provinsi").isNotNull()).select(*LEVELS).distinct()
    # Only what hangs on places counts.
    whole = paths.withColumns({n: F.expr(" AND ".join(f"{c} IS NOT NULL" for c in LEVELS[: LEVELS.index(c) + 1])) for n, c in under.items()})
    counted = [F.count_if(n).alias(n) for n in under]
    rolled = whole.rollup(*LEVELS).agg(F.grouping_id().alias("rolled"), *counted)
    level = F.lit(len(LEVELS)) - F.bit_count("rolled")
    place = F.array_position(F.transform(F.array(*LEVELS), lambda c: c.isNull()), F.lit(True))
    nodes = rolled.withColumn("level", level.cast("int"))
    return nodes.filter((F.col("level") > 0) & ((place == 0) | (place > F.col("level")))).drop("rolled")


def location_paths(nodes: DataFrame) -> DataFrame:
    """The places of ``location_nodes`` that have nothing under them, as paths."""
    leaf = "level = 4 OR level = 3 AND n_villages = 0 OR level = 2 AND n_districts = 0 OR level = 1 AND n_regencies = 0"
    return nodes.filter(leaf).select(*LEVELS)
