"""Roll-ups of station and grid observations.

First-row rules follow the ``id`` column; null group keys are left out, except in
``daily_to_monthly``. A location may be named (then a missing one is an error) or left out, in
which case the report is made for every location in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monsoon.functions.labels import province_name, same_text
from monsoon.functions.rounding import round_array, round_scalar
from monsoon.functions.spatial import degrees_to_km
from monsoon.functions.temporal import date_month, date_year, month_label
from monsoon.operators.contract import require_rows
from monsoon.operators.joins import lookup_join
from monsoon.operators.nearest import nearest_join

# Report name -> (source column, digits shown).
_SERIES = {
    "t2m": ("t2m", 1),
    "precip": ("prectotcorr", 1),
    "rh": ("rh2m", 1),
    "wind": ("ws2m", 2),
    "rad": ("allsky_sfc_sw_dwn", 2),
}


def _of_location(df: DataFrame, location_label: str | None) -> DataFrame:
    if location_label is None:
        return df.filter(F.col("location_label").isNotNull())
    sub = df.filter(same_text(F.col("location_label"), location_label))
    return require_rows(sub, f"no data for location '{location_label}'", LookupError)


def of_province(df: DataFrame, province: str) -> DataFrame:
    """Rows of a province given by short code or by name, in any letter case."""
    sub = df.filter(same_text(F.col("provinsi"), province_name(province)))
    return require_rows(sub, f"no data for province '{province}'", LookupError)


def daily_to_monthly(daily: DataFrame) -> DataFrame:
    """Station days to station months; days without a mean temperature do not count.

    The smallest flag is a text minimum, which Spark can only do by sorting. Grouping by the flag
    first keeps the pass over the days a hash aggregate; only station months meet the text minimum.
    """
    keys = {
        "location_label": F.col("station_id"),
        "station_name": F.col("station_name"),
        "year": date_year(F.col("date")),
        "month": date_month(F.col("date")),
        "lat": F.col("lat"),
        "lon": F.col("lon"),
    }
    per_flag = (
        daily.filter(F.col("tavg_c").isNotNull())
        .groupBy(*[c.alias(n) for n, c in keys.items()], "qc_flag")
        .agg(
            F.sum("tavg_c").alias("t_sum"),
            F.count("tavg_c").alias("t_days"),
            F.max("tmax_c").alias("t2m_max"),
            F.min("tmin_c").alias("t2m_min"),
            F.sum("prcp_mm").alias("prectotcorr"),
        )
    )
    return (
        per_flag.groupBy(*keys)
        .agg(
            (F.sum("t_sum") / F.sum("t_days")).alias("t2m"),
            F.max("t2m_max").alias("t2m_max"),
            F.min("t2m_min").alias("t2m_min"),
            F.sum("prectotcorr").alias("prectotcorr"),
            F.min("qc_flag").alias("qc_flag"),
        )
        .orderBy("location_label", "year", "month")
    )


def locations(df: DataFrame) -> DataFrame:
    """Distinct locations with mean coordinates."""
    return (
        df.filter(F.col("location_label").isNotNull())
        .groupBy(F.col("location_label").alias("label"))
        .agg(round_array(F.avg("lat"), 4).alias("lat"), round_array(F.avg("lon"), 4).alias("lon"))
    )


def years(df: DataFrame, location_label: str | None = None) -> DataFrame:
    """Years with data per location, ascending."""
    return (
        _of_location(df, location_label)
        .select("location_label", "year")
        .filter(F.col("year").isNotNull())
        .distinct()
        .orderBy("location_label", "year")
    )


def annual(df: DataFrame, location_label: str | None = None) -> DataFrame:
    """Yearly means, and the yearly sum of the monthly rain values."""
    means = {
        name: F.coalesce(F.sum(src), F.lit(0.0)) if name == "precip" else F.avg(src)
        for name, (src, _) in _SERIES.items()
    }
    rolled = (
        _of_location(df, location_label)
        .filter(F.col("year").isNotNull())
        .groupBy("location_label", "year")
        .agg(*[round_array(c, 2).alias(n) for n, c in means.items()])
    )
    return rolled.select("location_label", "year", *_shown()).orderBy("location_label", "year")


def _shown() -> list[Column]:
    return [round_scalar(F.col(n), digits).alias(n) for n, (_, digits) in _SERIES.items()]


def monthly_means(df: DataFrame) -> DataFrame:
    """(location, month) means at two digits, with each group's first position by id."""
    return df.groupBy("location_label", "month").agg(
        *[round_array(F.avg(src), 2).alias(n) for n, (src, _) in _SERIES.items()],
        F.min("id").alias("first_id"),
        F.min_by("lat", "id").alias("lat"),
        F.min_by("lon", "id").alias("lon"),
    )


def monthly_table(df: DataFrame) -> DataFrame:
    """Flat monthly climatology: one row per location and calendar month."""
    means = monthly_means(df.filter(F.col("location_label").isNotNull())).filter(F.col("month").between(1, 12))
    return means.select(
        "location_label", "month", month_label(F.col("month")).alias("month_label"), *_shown()
    )


def _series(df: DataFrame) -> DataFrame:
    in_year = F.col("month").between(1, 12)
    # The guard keeps the label lookup inside the array for stray month numbers.
    label = month_label(F.when(in_year, F.col("month")).otherwise(F.lit(1)))
    entry = F.struct(F.col("month").alias("no"), label.alias("month"), *_shown())
    rolled = (
        monthly_means(df)
        .groupBy("location_label")
        .agg(
            F.min_by("lat", "first_id").alias("lat"),
            F.min_by("lon", "first_id").alias("lon"),
            F.avg(F.when(F.col("month").isNotNull(), F.col("t2m"))).alias("normal"),
            F.sort_array(F.collect_list(F.when(in_year, entry))).alias("entries"),
        )
    )
    series = F.transform("entries", lambda e: F.struct(e["month"], *[e[n] for n in _SERIES]))
    return rolled.select(
        "location_label",
        "lat",
        "lon",
        round_scalar(F.col("normal"), 1).alias("normal_t2m"),
        series.alias("series"),
    )


def station_series(df: DataFrame, province: str) -> DataFrame:
    """Every location of a province: position, normal temperature, calendar-ordered series."""
    out = _series(of_province(df, province).filter(F.col("location_label").isNotNull()))
    return out.select(
        F.col("location_label").alias("label"),
        round_scalar(F.col("lat"), 4).alias("lat"),
        round_scalar(F.col("lon"), 4).alias("lon"),
        "normal_t2m",
        "series",
    ).orderBy("label")


def location_series(df: DataFrame, location_label: str | None = None, year: int | None = None) -> DataFrame:
    """Monthly series of a location over all years, or of one year."""
    sub = _of_location(df, location_label)
    if year is not None:
        sub = sub.filter(F.col("year") == year)
        if location_label is not None:
            require_rows(sub, f"no data for '{location_label}' in {year}", LookupError)
    return _series(sub).select(
        "location_label", F.lit(year).cast("int").alias("year"), "normal_t2m", "series"
    )


def flat_series(series: DataFrame, keys: list[str]) -> DataFrame:
    """Nested series -> one row per entry."""
    return series.select(*keys, F.inline("series"))


def stations(daily: DataFrame) -> DataFrame:
    """Distinct stations, each described by its first row.

    Descriptions are distinct values first (a hash aggregate over the days); the first row is then
    chosen among the few descriptions of a station.
    """
    described = ["station_id", "station_name", "lat", "lon"]
    seen = (
        daily.filter(F.col("station_id").isNotNull()).groupBy(*described).agg(F.min("id").alias("first_id"))
    )
    return seen.groupBy("station_id").agg(*[F.min_by(c, "first_id").alias(c) for c in described[1:]])


def nearest_stations(obs: DataFrame, daily: DataFrame, location_label: str | None = None) -> DataFrame:
    """Location -> nearest station with its distance in kilometres."""
    spots = (
        _of_location(obs, location_label)
        .groupBy("location_label")
        .agg(F.min_by("lat", "id").alias("lat"), F.min_by("lon", "id").alias("lon"))
    )
    paired = nearest_join(
        spots,
        stations(daily),
        {"station_id": "station_id", "station_name": "station_name"},
        ["station_id"],
        distance_col="d2",
    )
    return paired.select(
        "location_label",
        "station_id",
        "station_name",
        round_scalar(degrees_to_km(F.col("d2")), 1).alias("station_dist_km"),
    ).filter(F.col("station_id").isNotNull())


def station_daily(
    obs: DataFrame,
    daily: DataFrame,
    location_label: str | None = None,
    year: int | None = None,
    month: int | None = None,
) -> DataFrame:
    """Daily records of the station nearest to each location, by date."""
    rows = daily
    if year is not None:
        rows = rows.filter(date_year(F.col("date")) == year)
    if month is not None:
        rows = rows.filter(date_month(F.col("date")) == month)
    pairs = nearest_stations(obs, daily, location_label)
    # Several locations may share a station, so the pairs are keyed by both.
    rows = rows.select("station_id", "date", "tmax_c", "tmin_c", "tavg_c", "prcp_mm")
    out = lookup_join(rows, pairs, ["station_id"]).select(
        "location_label",
        "station_id",
        "station_name",
        "station_dist_km",
        F.col("date").cast("string").alias("date"),
        round_scalar(F.col("tmax_c"), 1).alias("tmax"),
        round_scalar(F.col("tmin_c"), 1).alias("tmin"),
        round_scalar(F.col("tavg_c"), 1).alias("tavg"),
        round_scalar(F.col("prcp_mm"), 1).alias("prcp"),
    )
    if location_label is not None:
        require_rows(out, f"no daily data near '{location_label}'", LookupError)
    return out.orderBy("location_label", "date")


def province_features(df: DataFrame, province: str, month: int, year: int | None = None) -> DataFrame:
    """Model inputs per location for a province and month."""
    if not 1 <= month <= 12:
        raise ValueError("month must be 1..12")
    sub = of_province(df, province)
    if year is not None:
        sub = require_rows(sub.filter(F.col("year") == year), f"no data for '{province}' in {year}", LookupError)
    sub = require_rows(sub.filter(F.col("month") == month), f"no data for '{province}' in month {month}", LookupError)

    def first_known(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("id"))).alias(name)

    return (
        sub.filter(F.col("location_label").isNotNull())
        .groupBy(F.col("location_label").alias("label"))
        .agg(
            first_known("lat"),
            first_known("lon"),
            F.avg("rh2m").alias("rh2m"),
            F.avg("ws2m").alias("ws2m"),
            F.avg("allsky_sfc_sw_dwn").alias("allsky_sfc_sw_dwn"),
        )
        .withColumn("month", F.lit(month))
    )


def grid_status(df: DataFrame) -> DataFrame:
    """One row: is there grid data, how much, and over which years and coordinates."""
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(c).alias(f"{c}_{n}") for c in ("year", "lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))],
    )

    def span(c: str) -> Column:
        return F.when(F.col("rows") > 0, F.format_string("%.2f s/d %.2f", f"{c}_lo", f"{c}_hi"))

    return stats.select(
        (F.col("rows") > 0).alias("available"),
        "rows",
        F.when(F.col("rows") > 0, F.format_string("%d–%d", "year_lo", "year_hi")).alias("year_range"),
        span("lat").alias("lat_range"),
        span("lon").alias("lon_range"),
        F.when(F.col("rows") == 0, F.lit("the grid table is empty, load it first")).alias("message"),
    )


_SAMPLED = {"lat": 4, "lon": 4, "rh2m": 1, "ws2m": 2, "allsky_sfc_sw_dwn": 2}


def sample_climate(df: DataFrame, location_label: str | None = None, month: int | None = None) -> DataFrame:
    """Mean climate inputs of a location and month; a filter without matches is ignored.

    One scan: rows are rolled up per location and month, then the widest set of filters that
    still has rows is picked from the four possible ones.
    """
    rolled = df.groupBy("location_label", "month").agg(
        F.min("id").alias("id"),
        *[f(c).alias(f"{c}_{n}") for c in _SAMPLED for n, f in (("sum", F.sum), ("n", F.count))],
    )
    always = F.lit(True)
    is_label = same_text(F.col("location_label"), location_label) if location_label else always
    is_month = (F.col("month") == month) if month else always
    tried = [is_label & is_month, is_label, is_month, always]

    def picture(keep: Column) -> Column:
        first = F.min_by(F.struct("location_label", "month"), F.when(keep, F.col("id")))
        means = [
            (F.sum(F.when(keep, F.col(f"{c}_sum"))) / F.nullif(F.sum(F.when(keep, F.col(f"{c}_n"))), F.lit(0))).alias(c)
            for c in _SAMPLED
        ]
        # Null when no row passes, so the next filter set is taken.
        return F.when(F.max(keep), F.struct(first.alias("first"), *means))

    best = rolled.agg(F.coalesce(*[picture(F.coalesce(k, F.lit(False))) for k in tried]).alias("s"))
    shown_month = F.lit(month) if month else F.col("s.first.month")
    return best.select(
        F.col("s.first.location_label").alias("location_label"),
        *[round_scalar(F.col(f"s.{c}"), d).alias(c) for c, d in _SAMPLED.items()],
        shown_month.cast("int").alias("month"),
    )
