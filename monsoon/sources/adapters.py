"""Climate-shaped views of the TPC-H-like test tables: plain projections.

Measures are multiples of powers of two, so sums and means do not depend on the order in which
an engine adds the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monsoon.functions.labels import weather_label, zone_category


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _d(c: Column) -> Column:
    return c.cast("double")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly climate observations (orders with their customer's nation and region)."""
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    j = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    ok, ck, nk = F.col("o_orderkey"), F.col("o_custkey"), F.col("n_nationkey")
    month = F.month("o_orderdate")
    t2m = _d(nk * 3 % 11) + _d(month * 5 % 12) / 4 + _d((ok * 37 + ck * 11) % 192) / 64 + 18.0
    return j.select(
        ok.alias("id"),
        F.col("n_name").alias("location_label"),
        F.col("r_name").alias("provinsi"),
        F.year("o_orderdate").alias("year"),
        month.alias("month"),
        t2m.alias("t2m"),
        (t2m + 4.0).alias("t2m_max"),
        (t2m - 5.0).alias("t2m_min"),
        _d(ok * 7 % 31).alias("allsky_sfc_sw_dwn"),
        _d(ok * 13 % 106).alias("rh2m"),
        (_d(ck % 60) / 8).alias("ws2m"),
        F.when(ok % 17 != 0, _d(ck * 3 % 160) / 8).alias("prectotcorr"),
        F.when(F.col("o_orderstatus") == "F", "RANGE:t2m=99")
        .when(F.col("o_orderstatus") == "O", "OK")
        .alias("qc_flag"),
        (_d(nk) / 2 - 10.0).alias("lat"),
        (_d(nk * 7 % 25) + 96.0).alias("lon"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather-forecast rows (events)."""
    e, u = F.col("event_id"), F.col("user_id")
    humidity = F.when(e % 19 != 0, _d(e * 13 % 106))
    cloud = _d(e * 29 % 101)
    return _table(spark, sf_dir, "events").select(
        e.alias("id"),
        F.concat(F.lit("P"), (u % 5).cast("string")).alias("provinsi"),
        F.concat(F.lit("K"), (u % 15).cast("string")).alias("kotkab"),
        F.concat(F.lit("C"), (u % 45).cast("string")).alias("kecamatan"),
        F.concat(F.lit("D"), u.cast("string")).alias("desa"),
        # The events cover one month: spread them over the year by whole days.
        F.date_format(F.col("ts") + F.make_dt_interval((u % 360).cast("int")), "yyyy-MM-dd HH:mm:ss").alias(
            "datetime_local"
        ),
        (F.floor("value").cast("double") / 8).alias("suhu_c"),
        humidity.alias("kelembaban_pct"),
        _d(e * 5 % 1100).alias("curah_hujan_mm"),
        _d(u % 40).alias("kecepatan_angin_kmh"),
        _d(e * 7 % 361).alias("arah_angin_deg"),
        cloud.alias("tutupan_awan_pct"),
        weather_label(humidity, cloud).alias("cuaca"),
        F.col("event_type").alias("source"),
        (_d(u % 17) - 11.0).alias("lat"),
        (_d(u % 46) + 95.0).alias("lon"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planning zones (supplier): a square of side two degrees around each centre."""
    k = F.col("s_suppkey")
    lat, lon = _d(k * 3 % 13) - 10.0, _d(k * 5 % 25) + 96.0

    def corner(dx: int, dy: int) -> Column:
        return F.concat((lon + float(dx)).cast("string"), F.lit(" "), (lat + float(dy)).cast("string"))

    ring = F.concat_ws(", ", *[corner(*d) for d in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    code = F.element_at(F.array(F.lit("R.1"), F.lit("K.1"), F.lit("H.1")), (k % 3 + 1).cast("int"))
    return _table(spark, sf_dir, "supplier").select(
        k.alias("id"),
        F.col("s_name").alias("nama_zona"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("kecamatan"),
        code.alias("kode_zona"),
        zone_category(code).alias("kategori_zona"),
        _d(k % 90).alias("luas_ha"),
        F.concat(F.lit("POLYGON(("), ring, F.lit("))")).alias("geom"),
        lat.alias("true_lat"),
        lon.alias("true_lon"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily station records (lineitem); the id repeats."""
    s = F.col("l_suppkey") % 40
    return _table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        s.cast("string").alias("station_id"),
        F.concat(F.lit("Station "), s.cast("string")).alias("station_name"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        (F.col("l_quantity") + 5.0).alias("tmax_c"),
        (F.col("l_quantity") - 5.0).alias("tmin_c"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("tavg_c"),
        F.rint(F.col("l_tax") * 100.0).alias("prcp_mm"),
        F.when(F.col("l_returnflag") == "R", "RANGE:x=1").otherwise("OK").alias("qc_flag"),
        (_d(s * 3 % 13) - 9.5).alias("lat"),
        (_d(s * 11 % 25) + 96.5).alias("lon"),
    )


def disaster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disaster counts per region and year (customer)."""
    k = F.col("c_custkey")
    code = k % 60
    return _table(spark, sf_dir, "customer").select(
        code.cast("string").alias("kode_wilayah"),
        F.concat(F.lit("W"), code.cast("string")).alias("nama_wilayah"),
        F.col("c_mktsegment").alias("level"),
        (k % 15 + 2010).cast("int").alias("year"),
        (k * 7 % 23 + code % 9).cast("int").alias("jumlah_kejadian"),
        F.when(k % 11 == 0, None).when(k % 13 == 0, "BAD").otherwise("OK").alias("qc_flag"),
        (_d(code * 3 % 13) - 9.25).alias("lat"),
        (_d(code * 7 % 25) + 96.25).alias("lon"),
    )


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-cover points (embeddings)."""
    v = F.col("vec_id")
    return _table(spark, sf_dir, "embeddings").select(
        v.alias("id"),
        F.lit(2021).alias("year"),
        ((F.col("label") + 1) * 10).cast("int").alias("landcover_class"),
        F.concat(F.lit("class "), F.col("label").cast("string")).alias("landcover_name"),
        F.lit("OK").alias("qc_flag"),
        (_d(v * 17 % 130) / 8 - 10.0).alias("lat"),
        (_d(v * 31 % 250) / 8 + 96.0).alias("lon"),
    )


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellite rain grid (part), position as WKT."""
    k = F.col("p_partkey")
    lon, lat = _d(k * 11 % 45) + 95.0, _d(k * 7 % 17) - 11.0
    return _table(spark, sf_dir, "part").select(
        k.alias("id"),
        (k % 20 + 2000).cast("int").alias("year"),
        (k % 12 + 1).cast("int").alias("month"),
        _d(F.col("p_size") * 50).alias("precipitation_mm"),
        F.lit("OK").alias("qc_flag"),
        F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")).alias("geom"),
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population points (customer), NaN where the balance is negative."""
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.lit(2020).alias("year"),
        F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.floor("c_acctbal").cast("double")).alias("population"),
        F.lit("OK").alias("qc_flag"),
        (_d(k % 170) / 8 - 11.0).alias("lat"),
        (_d(k % 46) + 95.0).alias("lon"),
    )


def land_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-grid months (orders)."""
    ok = F.col("o_orderkey")
    month = F.month("o_orderdate")
    t = 30.0 - _d(ok % 23) / 4 + _d(month * 5 % 12) / 8 + _d(ok * 37 % 16) / 16
    return _table(spark, sf_dir, "orders").select(
        ok.alias("id"),
        F.year("o_orderdate").alias("year"),
        month.alias("month"),
        t.alias("t2m_c"),
        (_d(ok * 3 % 160) / 1024).alias("total_precip_m"),
        F.when(ok % 13 != 0, t - 2.0 + _d(ok % 5) / 4).alias("soil_temp_c"),
        (_d(ok % 64) / 64).alias("soil_moisture"),
        (_d(ok % 23) / 4 - 9.0).alias("lat"),
        (_d(ok * 7 % 31) / 4 + 105.0).alias("lon"),
    )
