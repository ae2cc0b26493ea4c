"""SQL equivalents of the registered queries over the raw tables, for DuckDB.

Used to check results only; nothing in the package runs these texts.
"""

from __future__ import annotations

VIEWS = {
    "obs": """
SELECT o_orderkey AS id, n_name AS location_label, r_name AS provinsi,
       CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(n_nationkey * 3 % 11 AS DOUBLE) + CAST(month(o_orderdate) * 5 % 12 AS DOUBLE) / 4
         + CAST((o_orderkey * 37 + o_custkey * 11) % 192 AS DOUBLE) / 64 + 18e0 AS t2m,
       t2m + 4e0 AS t2m_max, t2m - 5e0 AS t2m_min,
       CAST(o_orderkey * 7 % 31 AS DOUBLE) AS allsky_sfc_sw_dwn,
       CAST(o_orderkey * 13 % 106 AS DOUBLE) AS rh2m,
       CAST(o_custkey % 60 AS DOUBLE) / 8 AS ws2m,
       CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_custkey * 3 % 160 AS DOUBLE) / 8 END AS prectotcorr,
       CASE o_orderstatus WHEN 'F' THEN 'RANGE:t2m=99' WHEN 'O' THEN 'OK' END AS qc_flag,
       CAST(n_nationkey AS DOUBLE) / 2 - 10e0 AS lat,
       CAST(n_nationkey * 7 % 25 AS DOUBLE) + 96e0 AS lon
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "weather": """
SELECT event_id AS id, 'P' || user_id % 5 AS provinsi, 'K' || user_id % 15 AS kotkab,
       'C' || user_id % 45 AS kecamatan, 'D' || user_id AS desa,
       strftime(ts + to_days(CAST(user_id % 360 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS datetime_local,
       floor(value) / 8 AS suhu_c,
       CASE WHEN event_id % 19 <> 0 THEN CAST(event_id * 13 % 106 AS DOUBLE) END AS kelembaban_pct,
       CAST(event_id * 5 % 1100 AS DOUBLE) AS curah_hujan_mm,
       CAST(user_id % 40 AS DOUBLE) AS kecepatan_angin_kmh,
       CAST(event_id * 7 % 361 AS DOUBLE) AS arah_angin_deg,
       CAST(event_id * 29 % 101 AS DOUBLE) AS tutupan_awan_pct,
       CASE WHEN kelembaban_pct > 85 AND tutupan_awan_pct > 70 THEN 'Hujan Ringan'
            WHEN tutupan_awan_pct > 50 THEN 'Berawan' WHEN tutupan_awan_pct > 20 THEN 'Cerah Berawan'
            ELSE 'Cerah' END AS cuaca,
       event_type AS source,
       CAST(user_id % 17 AS DOUBLE) - 11e0 AS lat, CAST(user_id % 46 AS DOUBLE) + 95e0 AS lon
FROM events""",
    "zones": """
SELECT s_suppkey AS id, s_name AS nama_zona, 'N' || s_nationkey AS kecamatan,
       CASE s_suppkey % 3 WHEN 0 THEN 'R.1' WHEN 1 THEN 'K.1' ELSE 'H.1' END AS kode_zona,
       CASE s_suppkey % 3 WHEN 0 THEN 'Permukiman' WHEN 1 THEN 'Komersial' ELSE 'RTH' END AS kategori_zona,
       CAST(s_suppkey % 90 AS DOUBLE) AS luas_ha,
       CAST(s_suppkey * 3 % 13 AS DOUBLE) - 10e0 AS centroid_lat,
       CAST(s_suppkey * 5 % 25 AS DOUBLE) + 96e0 AS centroid_lon
FROM supplier""",
    "daily": """
SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_suppkey % 40 AS VARCHAR) AS station_id,
       'Station ' || l_suppkey % 40 AS station_name, strftime(l_shipdate, '%Y-%m-%d') AS date,
       l_quantity + 5e0 AS tmax_c, l_quantity - 5e0 AS tmin_c,
       CASE WHEN l_linenumber <> 7 THEN l_quantity END AS tavg_c,
       round_even(l_tax * 1e2, 0) AS prcp_mm,
       CASE WHEN l_returnflag = 'R' THEN 'RANGE:x=1' ELSE 'OK' END AS qc_flag,
       CAST(l_suppkey % 40 * 3 % 13 AS DOUBLE) - 9.5e0 AS lat,
       CAST(l_suppkey % 40 * 11 % 25 AS DOUBLE) + 96.5e0 AS lon
FROM lineitem""",
    "disaster": """
SELECT CAST(c_custkey % 60 AS VARCHAR) AS kode_wilayah, 'W' || c_custkey % 60 AS nama_wilayah,
       c_mktsegment AS level, CAST(c_custkey % 15 + 2010 AS INTEGER) AS year,
       CAST(c_custkey * 7 % 23 + c_custkey % 60 % 9 AS INTEGER) AS jumlah_kejadian,
       CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'BAD' ELSE 'OK' END AS qc_flag,
       CAST(c_custkey % 60 * 3 % 13 AS DOUBLE) - 9.25e0 AS lat,
       CAST(c_custkey % 60 * 7 % 25 AS DOUBLE) + 96.25e0 AS lon
FROM customer""",
    "cover": """
SELECT vec_id AS id, 2021 AS year, CAST((label + 1) * 10 AS INTEGER) AS landcover_class,
       'class ' || label AS landcover_name, 'OK' AS qc_flag,
       CAST(vec_id * 17 % 130 AS DOUBLE) / 8 - 10e0 AS lat, CAST(vec_id * 31 % 250 AS DOUBLE) / 8 + 96e0 AS lon
FROM embeddings""",
    "rain": """
SELECT p_partkey AS id, CAST(p_partkey % 20 + 2000 AS INTEGER) AS year, CAST(p_partkey % 12 + 1 AS INTEGER) AS month,
       CAST(p_size * 50 AS DOUBLE) AS precipitation_mm, 'OK' AS qc_flag,
       CAST(p_partkey * 7 % 17 AS DOUBLE) - 11e0 AS lat, CAST(p_partkey * 11 % 45 AS DOUBLE) + 95e0 AS lon
FROM part""",
    "land": """
SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       30e0 - CAST(o_orderkey % 23 AS DOUBLE) / 4 + CAST(month(o_orderdate) * 5 % 12 AS DOUBLE) / 8
         + CAST(o_orderkey * 37 % 16 AS DOUBLE) / 16 AS t2m_celsius,
       CAST(o_orderkey * 3 % 160 AS DOUBLE) / 1024 AS precip_m,
       CASE WHEN o_orderkey % 13 <> 0 THEN t2m_celsius - 2e0 + CAST(o_orderkey % 5 AS DOUBLE) / 4 END AS soil_temp_c,
       CAST(o_orderkey % 64 AS DOUBLE) / 64 AS soil_moisture,
       CAST(o_orderkey % 23 AS DOUBLE) / 4 - 9e0 AS lat, CAST(o_orderkey * 7 % 31 AS DOUBLE) / 4 + 105e0 AS lon
FROM orders""",
}


def _scale(digits: int) -> str:
    return f"1e{digits}"


def half_even(x: str, digits: int) -> str:
    """Scaled rounding, halves to even."""
    return f"(round_even(({x}) * {_scale(digits)}, 0) / {_scale(digits)} + 0e0)"


def exact_round(x: str, digits: int) -> str:
    """Rounding of the exact binary value: the sign of the error of x * scale breaks apparent ties."""
    s = _scale(digits)
    head = f"(({x}) * 134217729e0 - (({x}) * 134217729e0 - ({x})))"
    low = f"floor(({x}) * {s})"
    over = f"(({head} * {s} - ({low} + 0.5e0)) + (({x}) - {head}) * {s})"
    return f"(({low} + CASE WHEN {over} > 0 OR ({over} = 0 AND {low} % 2 <> 0) THEN 1e0 ELSE 0e0 END) / {s})"


def _with(views: str, body: str, extra: str = "") -> str:
    parts = [f"{v} AS ({VIEWS[v]})" for v in views.split()]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n" + body


def _d2(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    return f"(({b_lat}) - ({a_lat})) * (({b_lat}) - ({a_lat})) + (({b_lon}) - ({a_lon})) * (({b_lon}) - ({a_lon}))"


SHOWN = {"t2m": ("t2m", 1), "precip": ("prectotcorr", 1), "rh": ("rh2m", 1), "wind": ("ws2m", 2),
         "rad": ("allsky_sfc_sw_dwn", 2)}
MONTH = "list_extract(['Jan','Feb','Mar','Apr','Mei','Jun','Jul','Agu','Sep','Okt','Nov','Des'], month)"


def _shown(alias: str = "m") -> str:
    return ", ".join(f"{exact_round(f'{alias}.{n}', d)} AS {n}" for n, (_, d) in SHOWN.items())


def _monthly(where: str) -> str:
    means = ", ".join(f"{half_even(f'avg({src})', 2)} AS {n}" for n, (src, _) in SHOWN.items())
    return f"m AS (SELECT location_label, month, {means} FROM obs WHERE {where} GROUP BY 1, 2)"


def _sample_weather(where: str, order: str) -> str:
    digits = {"suhu_c": 1, "kelembaban_pct": 1, "kecepatan_angin_kmh": 1, "arah_angin_deg": 0,
              "tutupan_awan_pct": 1, "curah_hujan_mm": 1, "lat": 4, "lon": 4}
    means = ", ".join(f"avg({c}) AS {c}" for c in digits)
    shown = ", ".join(f"{exact_round(c, d)} AS {c}" for c, d in digits.items())
    return _with(
        "weather",
        f"""SELECT {shown}, datetime_local, desa, actual_cuaca FROM (
 SELECT {means}, arg_min(datetime_local, id) AS datetime_local, arg_min(desa, id) AS desa,
        arg_min(cuaca, id) AS actual_cuaca FROM s)""",
        f"s AS (SELECT * FROM weather {where} {order})",
    )


def _sample_climate(asked: str, where: str, month: str) -> str:
    digits = {"lat": 4, "lon": 4, "rh2m": 1, "ws2m": 2, "allsky_sfc_sw_dwn": 2}
    means = ", ".join(f"avg({c}) AS {c}" for c in digits)
    shown = ", ".join(f"{exact_round(c, d)} AS {c}" for c, d in digits.items())
    return f"""SELECT location_label, {shown}, CAST({month} AS INTEGER) AS month, '{asked}' AS asked FROM (
 SELECT {means}, arg_min(location_label, id) AS location_label, arg_min(month, id) AS first_month
 FROM obs WHERE {where})"""


def _rule_branches() -> list[tuple[str, int, int]]:
    # The contract columns present in the weather view.
    return [("suhu_c", -10, 50), ("kelembaban_pct", 0, 100), ("curah_hujan_mm", 0, 1000),
            ("kecepatan_angin_kmh", 0, 500), ("arah_angin_deg", 0, 360), ("tutupan_awan_pct", 0, 100)]


def _scaled(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0e0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


def _nearest(left: str, right: str, key: str, l_xy: str, ties: str, cols: str) -> str:
    """One row per left key: the first right row by distance, then by the tie columns."""
    l_lat, l_lon = l_xy.split()
    d2 = _d2(f"l.{l_lat}", f"l.{l_lon}", "r.lat", "r.lon")
    return f"""SELECT * EXCLUDE (rn) FROM (
 SELECT l.*, {cols}, {d2} AS d2, row_number() OVER (PARTITION BY {key} ORDER BY {d2}, {ties}) AS rn
 FROM {left} l CROSS JOIN {right} r) WHERE rn = 1"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # ------------------------------------------------------------ loads
    sql["load_bmkg"] = _with("weather", "SELECT * EXCLUDE (source) FROM weather")
    sql["load_nasa_power"] = _with("obs", "SELECT * FROM obs")
    sql["load_chirps"] = _with(
        "rain", "SELECT * REPLACE (nullif(precipitation_mm, 350e0) AS precipitation_mm) FROM rain"
    )
    sql["load_rdtr"] = _with("zones", "SELECT * FROM zones")
    sql["load_era5"] = _with("land", "SELECT *, round(t2m_celsius + 273.15e0, 6) AS t2m_kelvin FROM land")
    sql["load_noaa_ghcn"] = _with("daily", "SELECT *, CAST(year(CAST(date AS DATE)) AS INTEGER) AS year FROM daily")
    sql["load_bnpb_disaster"] = _with("disaster", "SELECT * FROM disaster WHERE qc_flag = 'OK' OR qc_flag IS NULL")
    sql["load_worldcover"] = _with("cover", "SELECT * FROM cover")
    sql["load_worldpop"] = """
SELECT c_custkey AS id, 2020 AS year, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal) END AS population, 'OK' AS qc_flag,
       CAST(c_custkey % 170 AS DOUBLE) / 8 - 11e0 AS lat, CAST(c_custkey % 46 AS DOUBLE) + 95e0 AS lon FROM customer"""

    # ------------------------------------------------------------ contract
    branches = _rule_branches()
    sql["contract_violations"] = _with(
        "weather",
        "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS "column", CAST({lo} AS DOUBLE) AS min, CAST({hi} AS DOUBLE) AS max,
 count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS n_bad,
 count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) = 0 AS ok FROM weather"""
            for c, lo, hi in branches
        ),
    )
    tokens = ", ".join(
        f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN 'RANGE:{c}=' || printf('%g', {c}) END" for c, lo, hi in branches
    )
    sql["rule_flags"] = _with(
        "weather",
        f"""SELECT id, r <> '' AS rule_flag, CASE WHEN r = '' THEN 'OK' ELSE r END AS rule_reason
FROM (SELECT id, concat_ws('|', {tokens}) AS r FROM weather)""",
    )
    sql["qc_clean"] = _with("obs", "SELECT id, qc_flag, t2m FROM obs WHERE coalesce(qc_flag, 'OK') = 'OK'")
    share = exact_round("1e2 * clean_rows / total_rows", 1)
    sql["qc_log"] = _with(
        "obs",
        f"""SELECT *, {share} AS pct_clean FROM (SELECT provinsi AS source, count(*) AS total_rows,
 count(*) FILTER (WHERE coalesce(qc_flag, 'OK') = 'OK') AS clean_rows,
 count(*) FILTER (WHERE qc_flag <> 'OK') AS flagged_rows FROM obs GROUP BY 1)""",
    )
    sql["min_rows"] = "SELECT 50 AS minimum, count(*) >= 50 AS ok FROM supplier"
    # The accepted domain of weather scoring inputs.
    domain = [("suhu_c", -50, 60), ("kelembaban_pct", 0, 100), ("kecepatan_angin_kmh", 0, 500),
              ("arah_angin_deg", 0, 360), ("tutupan_awan_pct", 0, 100), ("lat", -11, 6), ("lon", 95, 141)]
    broken = ", ".join(
        f"CASE WHEN {c} IS NULL OR {c} < {lo} OR {c} > {hi} THEN '{c}' END" for c, lo, hi in domain
    )
    broken += ", CASE WHEN datetime_local IS NULL THEN 'datetime_local' END"
    sql["split_valid"] = _with(
        "weather",
        f"SELECT id, broken = '' AS valid, broken FROM (SELECT id, concat_ws('|', {broken}) AS broken FROM weather)",
    )
    sql["default_fill"] = _with(
        "weather",
        """SELECT id, coalesce(kelembaban_pct, 80e0) AS rh2m, 2e0 AS ws2m, 20e0 AS allsky_sfc_sw_dwn FROM weather""",
    )

    # ------------------------------------------------------------ features
    def wave(fn: str, value: str, period: int) -> str:
        return f"round({fn}(2e0 * pi() * {value} / {period}e0) + 0e0, 6)"

    sql["temporal_features"] = _with(
        "weather",
        f"""SELECT id, hour, month, CASE WHEN month IN (11, 12, 1, 2, 3, 4) THEN 'basah' ELSE 'kemarau' END AS musim,
 {wave('sin', 'hour', 24)} AS hour_sin, {wave('cos', 'hour', 24)} AS hour_cos,
 {wave('sin', 'month', 12)} AS month_sin, {wave('cos', 'month', 12)} AS month_cos
FROM (SELECT id, CAST(hour(t) AS INTEGER) AS hour, CAST(month(t) AS INTEGER) AS month FROM (
 SELECT id, CASE WHEN id % 23 <> 0 THEN CAST(datetime_local AS TIMESTAMP) END AS t FROM weather))""",
    )
    sql["cyclical_wind"] = _with(
        "weather",
        f"""SELECT id, abs(lat) AS abs_lat, {wave('sin', 'arah_angin_deg', 360)} AS arah_angin_deg_sin,
 {wave('cos', 'arah_angin_deg', 360)} AS arah_angin_deg_cos FROM weather""",
    )
    sql["weather_label"] = _with(
        "weather",
        """SELECT id, cuaca, CASE cuaca WHEN 'Cerah' THEN 'Clear Skies' WHEN 'Cerah Berawan' THEN 'Partly Cloudy'
 WHEN 'Berawan' THEN 'Mostly Cloudy' ELSE 'Light Rain' END AS cuaca_en FROM weather""",
    )
    sql["point_wkt"] = _with(
        "zones",
        """SELECT id, 'POINT (' || CAST(centroid_lon AS VARCHAR) || ' ' || CAST(centroid_lat AS VARCHAR) || ')' AS geom,
 kategori_zona FROM zones""",
    )
    sql["units_and_kelvin"] = _with(
        "obs",
        f"""SELECT id, CASE WHEN prectotcorr IS NULL THEN '°C' ELSE 'mm/hari' END AS unit,
 round(t2m + 273.15e0, 6) AS t2m_kelvin, {MONTH} AS month_label FROM obs""",
    )

    # ------------------------------------------------------------ nearest points
    sql["landcover_enrich"] = _with(
        "obs cover",
        "SELECT o.id, n.landcover_class FROM obs o JOIN near n ON o.lat = n.lat AND o.lon = n.lon",
        "spots AS (SELECT DISTINCT lat, lon FROM obs), near AS ("
        + _nearest("spots", "cover", "l.lat, l.lon", "lat lon", "r.id", "r.landcover_class")
        + ")",
    )
    sql["nearest_tree"] = _with(
        "weather rain",
        "SELECT w.id, n.rain_id, n.d2 FROM weather w JOIN near n ON w.lat = n.lat AND w.lon = n.lon",
        "spots AS (SELECT DISTINCT lat, lon FROM weather), near AS ("
        + _nearest("spots", "rain", "l.lat, l.lon", "lat lon", "r.id", "r.id AS rain_id")
        + ")",
    )
    km = exact_round("sqrt(d2) * 111e0", 1)
    stations = (
        "spots AS (SELECT location_label, arg_min(lat, id) AS lat, arg_min(lon, id) AS lon FROM obs GROUP BY 1), "
        "st AS (SELECT station_id, arg_min(station_name, id) AS station_name, arg_min(lat, id) AS lat, "
        "arg_min(lon, id) AS lon FROM daily GROUP BY 1), near AS ("
        + _nearest("spots", "st", "l.location_label", "lat lon", "r.station_id", "r.station_id, r.station_name")
        + f"), pairs AS (SELECT location_label, station_id, station_name, {km} AS station_dist_km FROM near)"
    )
    sql["nearest_stations"] = _with("obs daily", "SELECT * FROM pairs", stations)
    day = {"tmax": "tmax_c", "tmin": "tmin_c", "tavg": "tavg_c", "prcp": "prcp_mm"}
    sql["nearest_station_daily"] = _with(
        "obs daily",
        "SELECT location_label, station_id, station_dist_km, date, "
        + ", ".join(f"{exact_round(src, 1)} AS {n}" for n, src in day.items())
        + " FROM pairs JOIN daily USING (station_id)",
        stations,
    )
    here = _d2("-6.2e0", "106.8e0", "lat", "lon")
    sql["nearest_weather"] = _with(
        "weather", f"SELECT id, desa, round({here}, 6) AS d2 FROM weather ORDER BY {here}, id LIMIT 1"
    )

    # ------------------------------------------------------------ climatology
    sql["ghcn_monthly"] = _with(
        "daily",
        """SELECT station_id AS location_label, station_name, CAST(year(CAST(date AS DATE)) AS INTEGER) AS year,
 CAST(month(CAST(date AS DATE)) AS INTEGER) AS month, lat, lon, round(avg(tavg_c), 6) AS t2m, max(tmax_c) AS t2m_max,
 min(tmin_c) AS t2m_min, sum(prcp_mm) AS prectotcorr, min(qc_flag) AS qc_flag
FROM daily WHERE tavg_c IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6""",
    )
    sql["monthly_climatology"] = _with(
        "obs", f"SELECT location_label, month, {MONTH} AS month_label, {_shown()} FROM m", _monthly("true")
    )
    normal = exact_round("avg(t2m)", 1)
    sql["station_series"] = _with(
        "obs",
        f"""SELECT location_label AS label, {exact_round('p.lat', 4)} AS lat, {exact_round('p.lon', 4)} AS lon,
 normal_t2m, {MONTH} AS month, {_shown()}
FROM m JOIN (SELECT location_label, arg_min(lat, id) AS lat, arg_min(lon, id) AS lon FROM obs GROUP BY 1) p
 USING (location_label)
JOIN (SELECT location_label, {normal} AS normal_t2m FROM m GROUP BY 1) USING (location_label)""",
        _monthly("lower(provinsi) = 'asia'"),
    )
    sql["location_series"] = _with(
        "obs",
        f"""SELECT location_label, 1997 AS year, normal_t2m, {MONTH} AS month, {_shown()} FROM m
JOIN (SELECT location_label, {normal} AS normal_t2m FROM m GROUP BY 1) USING (location_label)""",
        _monthly("lower(location_label) = 'nation_3' AND year = 1997"),
    )
    yearly = ", ".join(
        half_even(f"coalesce(sum({src}), 0e0)" if n == "precip" else f"avg({src})", 2) + f" AS {n}"
        for n, (src, _) in SHOWN.items()
    )
    sql["annual_climate"] = _with(
        "obs",
        f"SELECT location_label, year, {_shown()} FROM m",
        f"m AS (SELECT location_label, year, {yearly} FROM obs GROUP BY 1, 2)",
    )
    sql["years"] = _with(
        "obs", "SELECT DISTINCT location_label, year FROM obs WHERE lower(location_label) = 'nation_3'"
    )
    sql["locations"] = _with(
        "obs",
        f"""SELECT location_label AS label, {half_even('avg(lat)', 4)} AS lat, {half_even('avg(lon)', 4)} AS lon
FROM obs GROUP BY 1""",
    )
    sql["province_features"] = _with(
        "obs",
        """SELECT location_label AS label, arg_min(lat, id) AS lat, arg_min(lon, id) AS lon, 7 AS month,
 round(avg(rh2m), 6) AS rh2m, round(avg(ws2m), 6) AS ws2m, round(avg(allsky_sfc_sw_dwn), 6) AS allsky_sfc_sw_dwn
FROM obs WHERE provinsi = 'ASIA' AND month = 7 GROUP BY 1""",
    )
    sql["grid_status"] = _with(
        "land",
        """SELECT count(*) > 0 AS available, count(*) AS rows, printf('%d–%d', min(year), max(year)) AS year_range,
 printf('%.2f s/d %.2f', min(lat), max(lat)) AS lat_range, printf('%.2f s/d %.2f', min(lon), max(lon)) AS lon_range,
 CAST(NULL AS VARCHAR) AS message FROM land""",
    )
    sql["sample_climate"] = _with(
        "obs",
        "\nUNION ALL\n".join(
            [
                _sample_climate("nation_3/4", "lower(location_label) = 'nation_3' AND month = 4", "4"),
                _sample_climate("nowhere/5", "month = 5", "5"),
                _sample_climate("None/None", "true", "first_month"),
            ]
        ),
    )
    sql["sample_weather"] = _sample_weather("WHERE provinsi = 'P1' AND kotkab = 'K6'", "")
    sql["sample_weather_point"] = _sample_weather(
        "", f"ORDER BY {_d2('-3e0', '110e0', 'lat', 'lon')}, id LIMIT 1"
    )
    sql["sample_weather_random"] = _sample_weather("", "ORDER BY md5(id || '-42'), id LIMIT 1")
    sql["location_hierarchy"] = _with(
        "weather",
        """SELECT provinsi, kotkab, kecamatan, desa FROM t WHERE desa IS NOT NULL
UNION ALL SELECT provinsi, kotkab, kecamatan, NULL FROM t GROUP BY 1, 2, 3 HAVING count(desa) = 0""",
        "t AS (SELECT DISTINCT provinsi, kotkab, kecamatan, nullif(desa, 'D7') AS desa FROM weather)",
    )

    place = "kotkab IS NOT NULL"
    sql["location_levels"] = _with(
        "weather",
        f"""SELECT provinsi, NULL AS kotkab, NULL AS kecamatan, NULL AS desa, 1 AS level, {{counts}} FROM t GROUP BY provinsi
UNION ALL SELECT provinsi, kotkab, NULL, NULL, 2, {{counts}} FROM t WHERE {place} GROUP BY ALL
UNION ALL SELECT provinsi, kotkab, kecamatan, NULL, 3, {{counts}} FROM t WHERE {place} AND kecamatan IS NOT NULL GROUP BY ALL
UNION ALL SELECT provinsi, kotkab, kecamatan, desa, 4, {{counts}} FROM t WHERE {place} AND kecamatan IS NOT NULL AND desa IS NOT NULL
GROUP BY ALL""".replace(
            "{counts}",
            f"count(*) FILTER ({place}) AS n_regencies, count(*) FILTER ({place} AND kecamatan IS NOT NULL) AS n_districts, "
            f"count(*) FILTER ({place} AND kecamatan IS NOT NULL AND desa IS NOT NULL) AS n_villages",
        ),
        """t AS (SELECT DISTINCT provinsi, CASE WHEN id % 5 <> 0 THEN kotkab END AS kotkab, kecamatan, nullif(desa, 'D7') AS desa
 FROM weather WHERE provinsi IS NOT NULL)""",
    )

    # ------------------------------------------------------------ risk
    weights = [("avg_tmax", "0.5e0"), ("avg_precip", "0.3e0"), ("avg_humidity", "0.2e0")]
    score = " + ".join(f"{w} * ({_scaled(c)})" for c, w in weights)
    sql["zone_risk"] = _with(
        "obs zones",
        f"""SELECT *, CASE WHEN risk_score <= 0.33e0 THEN 'Rendah' WHEN risk_score <= 0.66e0 THEN 'Sedang' ELSE 'Tinggi' END
 AS risk_level FROM (SELECT *, {half_even(score, 3)} AS risk_score FROM (
 SELECT nama_zona, kecamatan, kategori_zona, luas_ha, centroid_lat, centroid_lon,
  {exact_round('avg_tmax', 1)} AS avg_tmax, {exact_round('avg_precip', 2)} AS avg_precip,
  {exact_round('avg_humidity', 0)} AS avg_humidity FROM near))""",
        """pts AS (SELECT lat, lon, avg(t2m_max) AS avg_tmax, avg(prectotcorr) AS avg_precip, avg(rh2m) AS avg_humidity
 FROM obs WHERE provinsi = 'ASIA' GROUP BY 1, 2), near AS ("""
        + _nearest("zones", "pts", "l.id", "centroid_lat centroid_lon", "r.lat, r.lon",
                   "r.avg_tmax, r.avg_precip, r.avg_humidity")
        + ")",
    )
    sql["disaster_training_set"] = _with(
        "obs disaster",
        """SELECT kode_wilayah, nama_wilayah, lat, lon, nearest_climate, round(avg_t2m, 6) AS avg_t2m,
 round(avg_tmax, 6) AS avg_tmax, round(avg_precip, 6) AS avg_precip, round(avg_rh2m, 6) AS avg_rh2m,
 round(freq, 6) AS avg_kejadian_per_tahun FROM near""",
        """profile AS (SELECT location_label, lat, lon, avg(t2m) AS avg_t2m, avg(t2m_max) AS avg_tmax,
 avg(prectotcorr) AS avg_precip, avg(rh2m) AS avg_rh2m FROM obs GROUP BY 1, 2, 3),
 regions AS (SELECT kode_wilayah, nama_wilayah, lat, lon, avg(jumlah_kejadian) AS freq FROM disaster
 WHERE qc_flag = 'OK' OR qc_flag IS NULL GROUP BY 1, 2, 3, 4), near AS ("""
        + _nearest("regions", "profile", "l.kode_wilayah", "lat lon", "r.location_label, r.lat, r.lon",
                   "r.location_label AS nearest_climate, r.avg_t2m, r.avg_tmax, r.avg_precip, r.avg_rh2m")
        + ")",
    )
    sql["risk_quantiles"] = _with(
        "disaster",
        """SELECT kode_wilayah, round(q33, 6) AS q33, round(q66, 6) AS q66,
 CASE WHEN m <= q33 THEN 'Rendah' WHEN m <= q66 THEN 'Sedang' ELSE 'Tinggi' END AS risk_level
FROM (SELECT kode_wilayah, avg(jumlah_kejadian) AS m FROM disaster GROUP BY 1), q""",
        """q AS (SELECT quantile_cont(CAST(jumlah_kejadian AS DOUBLE), 0.33) AS q33,
 quantile_cont(CAST(jumlah_kejadian AS DOUBLE), 0.66) AS q66 FROM disaster)""",
    )

    # ------------------------------------------------------------ order statistics, folds, metrics
    sql["column_medians"] = _with(
        "weather",
        "\nUNION ALL\n".join(
            f"SELECT '{c}' AS \"column\", median({c}) AS median, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM weather"
            for c in ("suhu_c", "kelembaban_pct", "curah_hujan_mm", "kecepatan_angin_kmh")
        ),
    )
    contiguous = (
        "(SELECT *, CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1) "
        "ELSE n % 5 + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM "
        "(SELECT *, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM {view}))"
    )
    sql["contiguous_folds"] = _with("weather", f"SELECT id, fold FROM {contiguous.format(view='weather')}")
    sql["contiguous_folds_daily"] = _with(
        "daily",
        """SELECT id, prcp_mm, CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1)
 ELSE n % 5 + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold
FROM (SELECT id, prcp_mm, row_number() OVER (ORDER BY id, prcp_mm) - 1 AS r, count(*) OVER () AS n FROM daily)""",
    )
    dealt = """c AS (SELECT cuaca, count(*) AS n, min(id) AS first FROM weather GROUP BY 1),
 c2 AS (SELECT cuaca, n, sum(n) OVER (ORDER BY first) - n AS s FROM c),
 a AS (SELECT cuaca, f, count(*) FILTER (WHERE p % 5 = f) AS k FROM
   (SELECT cuaca, unnest(generate_series(CAST(s AS BIGINT), CAST(s + n - 1 AS BIGINT))) AS p FROM c2), range(5) g(f) GROUP BY 1, 2),
 b AS (SELECT cuaca, f, sum(k) OVER (PARTITION BY cuaca ORDER BY f) AS upto FROM a),
 r AS (SELECT *, row_number() OVER (PARTITION BY cuaca ORDER BY id) - 1 AS r FROM weather),
 folded AS (SELECT r.id, r.cuaca, CAST((SELECT count(*) FROM b WHERE b.cuaca = r.cuaca AND b.upto <= r.r) AS INTEGER) AS fold
   FROM r)"""
    sql["stratified_folds"] = _with("weather", "SELECT id, cuaca, fold FROM folded", dealt)
    sql["baseline_mean"] = _with(
        "obs",
        "SELECT CAST(a.fold AS INTEGER) AS fold, round(avg(o.t2m), 6) AS prediction FROM range(5) a(fold) JOIN f o ON o.fold <> a.fold GROUP BY 1",
        f"f AS (SELECT * FROM {contiguous.format(view='obs')})",
    )
    clean = "(SELECT * FROM obs WHERE coalesce(qc_flag, 'OK') = 'OK' AND t2m IS NOT NULL)"
    sql["climate_gate_data"] = _with(
        "obs",
        """SELECT count(*) AS data_rows, round(avg(abs(t2m - p)), 6) AS baseline_mae,
 round(sqrt(avg((t2m - p) * (t2m - p))), 6) AS baseline_rmse FROM f JOIN b USING (fold)""",
        f"""f AS (SELECT * FROM {contiguous.format(view=clean)}),
 b AS (SELECT a.fold, avg(o.t2m) AS p FROM range(5) a(fold) JOIN f o ON o.fold <> a.fold GROUP BY 1)""",
    )
    sql["forest_walk"] = _with(
        "weather",
        """SELECT id, round(-pow(2e0, -(CASE WHEN coalesce(suhu_c, 10) <= 10 THEN 1e0 WHEN coalesce(kelembaban_pct, 60) <= 50 THEN 2e0
 ELSE 2.5e0 END + 1.5e0) / 2 / (2 * (ln(255e0) + 0.5772156649015329e0) - 510e0 / 256)), 9) AS score FROM weather""",
    )
    sql["baseline_mode"] = _with(
        "weather",
        """SELECT CAST(fold AS INTEGER) AS fold, cuaca AS prediction FROM (SELECT a.fold, w.cuaca,
 row_number() OVER (PARTITION BY a.fold ORDER BY count(*) DESC, w.cuaca) AS rn
 FROM range(5) a(fold) JOIN folded w ON w.fold <> a.fold GROUP BY 1, 2) WHERE rn = 1""",
        dealt,
    )
    sql["weather_baseline_metrics"] = _with(
        "weather",
        """SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * s) / sum(s), 6) AS weighted_f1 FROM (
 SELECT x, count(*) FILTER (WHERE cuaca = x) AS s, 2e0 * count(*) FILTER (WHERE cuaca = x AND prediction = x)
  / (count(*) FILTER (WHERE cuaca = x) + count(*) FILTER (WHERE prediction = x)) AS f1 FROM l, based GROUP BY 1)""",
        dealt
        + """, base AS (SELECT fold, cuaca AS prediction FROM (SELECT a.fold, w.cuaca,
 row_number() OVER (PARTITION BY a.fold ORDER BY count(*) DESC, w.cuaca) AS rn
 FROM range(5) a(fold) JOIN folded w ON w.fold <> a.fold GROUP BY 1, 2) WHERE rn = 1),
 based AS (SELECT cuaca, prediction FROM folded JOIN base USING (fold)),
 l AS (SELECT cuaca AS x FROM based UNION SELECT prediction FROM based)""",
    )
    sql["climate_baseline_metrics"] = _with(
        "obs",
        """SELECT round(avg(abs(t2m - prediction)), 6) AS mae, round(sqrt(avg((t2m - prediction) * (t2m - prediction))), 6) AS rmse,
 round(1e0 - avg((t2m - prediction) * (t2m - prediction)) / var_pop(t2m), 6) AS r2 FROM f JOIN base USING (fold)""",
        f"""f AS (SELECT * FROM {contiguous.format(view='obs')}),
 base AS (SELECT a.fold, avg(o.t2m) AS prediction FROM range(5) a(fold) JOIN f o ON o.fold <> a.fold GROUP BY 1)""",
    )
    sql["classification_metrics"] = """
WITH l AS (SELECT quality AS x FROM labels UNION SELECT toxic FROM labels),
f AS (SELECT x, count(*) FILTER (WHERE quality = x) AS s,
      2e0 * count(*) FILTER (WHERE quality = x AND toxic = x)
        / (count(*) FILTER (WHERE quality = x) + count(*) FILTER (WHERE toxic = x)) AS f1 FROM l, labels GROUP BY 1)
SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * s) / sum(s), 6) AS weighted_f1 FROM f"""
    prices = """p AS (SELECT l_returnflag, l_extendedprice / l_quantity AS y, p_retailprice AS x
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""
    sql["regression_metrics"] = (
        f"WITH {prices} "
        """SELECT l_returnflag, round(avg(abs(y - x)), 4) AS mae, round(sqrt(avg((y - x) * (y - x))), 4) AS rmse,
 round(1e0 - avg((y - x) * (y - x)) / var_pop(y), 6) AS r2 FROM p GROUP BY 1"""
    )
    sql["skill_score"] = (
        f"WITH {prices}, m AS (SELECT avg(y) AS m FROM p) "
        "SELECT round(1e0 - avg(abs(y - x)) / avg(abs(y - m)), 6) AS skill FROM p, m"
    )
    sql["conformal_interval"] = _with(
        "obs",
        f"""SELECT CAST(fold AS INTEGER) AS fold, ci_q90, {exact_round('prediction - ci_q90', 2)} AS ci_low,
 {exact_round('prediction + ci_q90', 2)} AS ci_high FROM base, q""",
        f"""f AS (SELECT * FROM {contiguous.format(view='obs')}),
 base AS (SELECT a.fold, avg(o.t2m) AS prediction FROM range(5) a(fold) JOIN f o ON o.fold <> a.fold GROUP BY 1),
 q AS (SELECT round(quantile_cont(abs(f.t2m - base.prediction), 0.9), 4) AS ci_q90 FROM f JOIN base USING (fold))""",
    )
    sql["min_max_scale"] = _with(
        "weather",
        f"""SELECT id, round({_scaled('suhu_c')}, 6) AS suhu_c, round({_scaled('curah_hujan_mm')}, 6) AS curah_hujan_mm,
 0e0 AS flat FROM weather""",
    )
    sql["smallest_class"] = _with(
        "weather",
        "SELECT min(n) AS smallest, count(*) AS classes FROM (SELECT cuaca, count(*) AS n FROM weather GROUP BY 1)",
    )

    # ------------------------------------------------------------ sinks
    sql["dedupe_append"] = _with(
        "weather",
        """SELECT ref_month, geom, arg_min(predicted, id) AS predicted, min(id) AS id FROM n
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.ref_month IS NOT DISTINCT FROM n.ref_month AND s.geom = n.geom)
GROUP BY 1, 2""",
        """k AS (SELECT id, cuaca AS predicted, CASE WHEN id % 3 <> 0 THEN CAST(substr(datetime_local, 6, 2) AS INTEGER) END AS ref_month,
  'POINT (' || CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')' AS geom FROM weather),
 s AS (SELECT * FROM k WHERE predicted = 'Cerah'), n AS (SELECT * FROM k WHERE predicted <> 'Cerah')""",
    )
    stored = """SELECT id AS source_id, v AS model_version, cuaca AS predicted,
 CAST(substr(datetime_local, 6, 2) AS INTEGER) AS ref_month,
 'POINT (' || CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')' AS geom FROM weather, (VALUES {versions}) AS t(v)"""
    sql["append_predictions"] = _with("weather", stored.format(versions="('1.10'), ('1.10')"))
    sql["idempotent_append"] = _with("weather", stored.format(versions="('1.1'), ('1.10')"))
    sql["stream_append_once"] = _with("weather", stored.format(versions="('1.10')"))
    sql["stream_nearest"] = sql["nearest_tree"]
    sql["append_anomalies"] = f"""SELECT 'bmkg_forecast' AS source_table, id AS source_id, rule_flag AS is_anomaly,
 rule_reason AS reason FROM ({sql["rule_flags"]})"""
    sql["catalog_parquet"] = sql["catalog_json"] = sql["load_bmkg_wkb"] = sql["load_bmkg"]
    sql["load_rdtr_wkb"] = sql["load_rdtr"]
    # ------------------------------------------------------------ result shaping
    picked = ", ".join(f"{exact_round(f'CAST(id % {m} + 1 AS DOUBLE) / t', 4)} AS p{m}" for m in (7, 5, 3))
    sql["best_class"] = _with(
        "weather",
        f"""SELECT id, CASE greatest(p7, p5, p3) WHEN p7 THEN 'Berawan' WHEN p5 THEN 'Cerah' ELSE 'Hujan' END AS predicted,
 greatest(p7, p5, p3) AS proba FROM (SELECT id, {picked} FROM (
 SELECT id, CAST(id % 7 + 1 AS DOUBLE) + (id % 5 + 1) + (id % 3 + 1) AS t FROM weather))""",
    )
    share = exact_round("raw / whole", 4)
    sql["attribution_groups"] = _with(
        "weather",
        f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY raw DESC, slot) - 1 AS INTEGER) AS rank, f,
 {share} AS w, {exact_round('raw', 6)} AS raw
FROM (SELECT id, slot, f, raw, CASE WHEN whole = 0 THEN 1e0 ELSE whole END AS whole FROM (
 SELECT *, sum(raw) OVER (PARTITION BY id) AS whole FROM (
  SELECT id, 0 AS slot, 'kelembaban (RH)' AS f, coalesce(kelembaban_pct, 0e0) AS raw FROM weather
  UNION ALL SELECT id, 1, 'kecepatan angin', kecepatan_angin_kmh FROM weather
  UNION ALL SELECT id, 2, 'radiasi surya', tutupan_awan_pct FROM weather
  UNION ALL SELECT id, 3, 'koordinat', abs(lat) + abs(lon) FROM weather
  UNION ALL SELECT id, 4, 'bulan', arah_angin_deg + curah_hujan_mm FROM weather)))""",
    )
    return sql
