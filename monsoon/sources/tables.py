"""Typed loads of the climate tables from Parquet, JSON files or a JDBC database."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monsoon.functions import spatial, wkb
from monsoon.functions.spatial import point_lat, point_lon, polygon_centroid
from monsoon.functions.temporal import date_year
from monsoon.operators.contract import qc_clean

_TYPES = {"l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "s": T.StringType()}


@dataclass(frozen=True)
class Table:
    """Columns as ``name:type`` (l long, i int, d double, s string) and the geometry kind."""

    name: str
    columns: tuple[str, ...]
    geometry: str = "point"
    optional: frozenset[str] = field(default_factory=frozenset)

    @property
    def schema(self) -> T.StructType:
        parts = [c.split(":") for c in self.columns]
        return T.StructType([T.StructField(n, _TYPES[t]) for n, t in parts])

    @property
    def position(self) -> tuple[str, str]:
        return ("centroid_lat", "centroid_lon") if self.geometry == "polygon" else ("lat", "lon")


# Table names, columns and types of the climate database.
BMKG = Table(
    "bmkg_forecast",
    ("id:l", "provinsi:s", "kotkab:s", "kecamatan:s", "desa:s", "kode_adm4:s", "datetime_utc:s", "datetime_local:s",
     "suhu_c:d", "kelembaban_pct:d", "curah_hujan_mm:d", "kecepatan_angin_kmh:d", "arah_angin_deg:d",
     "tutupan_awan_pct:d", "cuaca:s", "cuaca_en:s", "qc_flag:s", "lat:d", "lon:d"),
)
NASA = Table(
    "nasa_power_monthly",
    ("id:l", "location_label:s", "provinsi:s", "year:i", "month:i", "t2m:d", "t2m_max:d", "t2m_min:d",
     "allsky_sfc_sw_dwn:d", "rh2m:d", "ws2m:d", "prectotcorr:d", "qc_flag:s", "lat:d", "lon:d"),
)
CHIRPS = Table("chirps_monthly", ("id:l", "year:i", "month:i", "precipitation_mm:d", "qc_flag:s", "lat:d", "lon:d"))
RDTR = Table(
    "rdtr_pola_ruang",
    ("id:l", "kota:s", "kecamatan:s", "kelurahan:s", "kode_zona:s", "nama_zona:s", "kategori_zona:s", "luas_ha:d",
     "sumber_data:s", "centroid_lat:d", "centroid_lon:d"),
    geometry="polygon",
)
ERA5 = Table("era5_monthly", ("id:l", "year:i", "month:i", "t2m_kelvin:d", "t2m_celsius:d", "lat:d", "lon:d"))
ERA5_LAND = Table(
    "era5_land_monthly",
    ("id:l", "year:i", "month:i", "t2m_c:d", "total_precip_m:d", "soil_temp_c:d", "soil_moisture:d", "lat:d", "lon:d"),
)
GHCN = Table(
    "noaa_ghcn_daily",
    ("id:l", "station_id:s", "station_name:s", "date:s", "tmax_c:d", "tmin_c:d", "tavg_c:d", "prcp_mm:d",
     "qc_flag:s", "lat:d", "lon:d"),
)
DISASTER = Table(
    "bnpb_disaster",
    ("kode_wilayah:s", "nama_wilayah:s", "level:s", "year:i", "jumlah_kejadian:i", "qc_flag:s", "lat:d", "lon:d"),
)
WORLDCOVER = Table(
    "worldcover_landuse",
    ("id:l", "year:i", "landcover_class:i", "landcover_name:s", "qc_flag:s", "lat:d", "lon:d"),
)
WORLDPOP = Table("worldpop_population", ("id:l", "year:i", "population:d", "qc_flag:s", "lat:d", "lon:d"))
QC_LOG = Table(
    "qc_log",
    ("source:s", "run_timestamp:s", "total_rows:l", "clean_rows:l", "flagged_rows:l", "pct_clean:d"),
    geometry="none",
)
TABLES = {
    t.name: t
    for t in (BMKG, NASA, CHIRPS, RDTR, ERA5, ERA5_LAND, GHCN, DISASTER, WORLDCOVER, WORLDPOP, QC_LOG)
}
MISSING_SENTINEL = -999.0


def conform(df: DataFrame, table: Table, sentinel: float | None = None) -> DataFrame:
    """Project any frame to a table's columns and types.

    Positions come from ``geom`` (WKT, or WKB if it is binary) when the frame has no coordinate columns; NaN (and the
    sentinel, when given) becomes null here and nowhere else; an absent column is null.
    """
    lat_name, lon_name = table.position
    derived: dict[str, Column] = {}
    geom = next((c for c in ("geom", "geom_wkt") if c in df.columns), None)
    if geom and lat_name not in df.columns:
        form = wkb if df.schema[geom].dataType == T.BinaryType() else spatial
        if table.geometry == "polygon":
            # Its own projection: the outline is read once for both coordinates.
            df = df.withColumn("__centre", form.polygon_centroid(F.col(geom)))
            derived = {lat_name: F.col("__centre.lat"), lon_name: F.col("__centre.lon")}
        else:
            derived = {lat_name: form.point_lat(F.col(geom)), lon_name: form.point_lon(F.col(geom))}

    def column(f: T.StructField) -> Column:
        if f.name in derived:
            return derived[f.name].alias(f.name)
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f.name)
        if f.dataType == T.DoubleType():
            c = c.cast("double")
            if df.schema[f.name].dataType in (T.DoubleType(), T.FloatType()):
                c = F.nanvl(c, F.lit(None).cast("double"))
            if sentinel is not None:
                c = F.nullif(c, F.lit(float(sentinel)))
        return c.cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in table.schema.fields])


# ---------------------------------------------------------------- readers


def read_parquet(spark: SparkSession, root: str, table: Table, sentinel: float | None = None) -> DataFrame:
    return conform(spark.read.parquet(f"{root}/{table.name}"), table, sentinel)


def read_json(
    spark: SparkSession, root: str, table: Table, sentinel: float | None = None, lines: bool = False
) -> DataFrame:
    """JSON files with a fixed schema; ``lines`` for one object per line (splittable)."""
    known = table.schema.add("geom", T.StringType()).add("geom_wkt", T.StringType())
    raw = (
        spark.read.schema(known)
        .option("multiLine", not lines)
        .option("mode", "FAILFAST")
        .json(f"{root}/{table.name}.json")
    )
    # The file may carry ready coordinates, a geometry, or both.
    lat_name, lon_name = table.position
    if table.geometry == "none":
        return conform(raw, table, sentinel)
    geom = F.coalesce("geom", "geom_wkt")
    if table.geometry == "polygon":
        raw = raw.withColumn("__centre", polygon_centroid(geom))
        lat, lon = F.col("__centre.lat"), F.col("__centre.lon")
    else:
        lat, lon = point_lat(geom), point_lon(geom)
    filled = raw.withColumns({lat_name: F.coalesce(lat_name, lat), lon_name: F.coalesce(lon_name, lon)})
    return conform(filled, table, sentinel)


def read_jdbc(
    spark: SparkSession,
    options: Mapping[str, str],
    table: Table,
    sentinel: float | None = None,
    id_bounds: tuple[int, int] | None = None,
    partitions: int = 32,
) -> DataFrame:
    """A spatial database table; geometry leaves the database as text.

    With ``id_bounds`` the table is read in parallel ranges of its id.
    """
    lat_name, lon_name = table.position
    names = [f.name for f in table.schema.fields if f.name not in (lat_name, lon_name)]
    listed = ", ".join(names if table.geometry == "none" else [*names, "ST_AsText(geom) AS geom"])
    reader = spark.read.format("jdbc").options(**options).option("dbtable", f"(SELECT {listed} FROM {table.name}) t")
    if id_bounds is not None and "id" in names:
        reader = (
            reader.option("partitionColumn", "id")
            .option("lowerBound", id_bounds[0])
            .option("upperBound", id_bounds[1])
            .option("numPartitions", partitions)
        )
    return conform(reader.load(), table, sentinel)


@dataclass(frozen=True)
class Catalog:
    """Where the climate tables live: ``kind`` parquet, json or jdbc."""

    spark: SparkSession
    kind: str = "parquet"
    root: str = ""
    jdbc: Mapping[str, str] = field(default_factory=dict)
    sentinel: float | None = None
    json_lines: bool = False  # one object per line: files can then be split
    id_bounds: tuple[int, int] | None = None  # smallest and largest id, to read a database table in parallel
    partitions: int = 32

    def read(self, table: Table, df: DataFrame | None = None) -> DataFrame:
        """The table, or an injected frame brought to the table's shape."""
        if df is not None:
            return conform(df, table, self.sentinel)
        if self.kind == "parquet":
            return read_parquet(self.spark, self.root, table, self.sentinel)
        if self.kind == "json":
            return read_json(self.spark, self.root, table, self.sentinel, self.json_lines)
        if self.kind == "jdbc":
            return read_jdbc(self.spark, self.jdbc, table, self.sentinel, self.id_bounds, self.partitions)
        raise ValueError(f"unknown source kind '{self.kind}' (parquet, json, jdbc)")

    def bmkg(self, df: DataFrame | None = None) -> DataFrame:
        return self.read(BMKG, df)

    def nasa_power(self, df: DataFrame | None = None) -> DataFrame:
        return self.read(NASA, df)

    def chirps(self, df: DataFrame | None = None) -> DataFrame:
        return self.read(CHIRPS, df)

    def rdtr(self, df: DataFrame | None = None) -> DataFrame:
        return self.read(RDTR, df)

    def era5(self, df: DataFrame | None = None, land: DataFrame | None = None) -> DataFrame:
        """The coarse grid, or the land grid in the same shape when the coarse one is empty."""
        grid = self.read(ERA5, df)
        return self.era5_land(land) if grid.isEmpty() else grid

    def era5_land(self, df: DataFrame | None = None) -> DataFrame:
        return era5_land_shape(self.read(ERA5_LAND, df))

    def noaa_ghcn(self, df: DataFrame | None = None) -> DataFrame:
        return with_year(self.read(GHCN, df))

    def bnpb_disaster(self, df: DataFrame | None = None, ordered: bool = True) -> DataFrame:
        """Clean disaster rows by region and year; training needs no order and skips the sort."""
        return clean_disasters(self.read(DISASTER, df), ordered)

    def worldcover(self, df: DataFrame | None = None) -> DataFrame:
        return self.read(WORLDCOVER, df)

    def worldpop(self, df: DataFrame | None = None) -> DataFrame:
        return self.read(WORLDPOP, df)

    def qc_log(self, df: DataFrame | None = None) -> DataFrame:
        return self.read(QC_LOG, df)


def era5_land_shape(df: DataFrame) -> DataFrame:
    """Land-grid columns renamed to the coarse grid's, with the temperature in kelvin added."""
    return df.select(
        "id",
        "year",
        "month",
        F.col("t2m_c").alias("t2m_celsius"),
        F.col("total_precip_m").alias("precip_m"),
        "soil_temp_c",
        "soil_moisture",
        "lat",
        "lon",
        (F.col("t2m_c") + F.lit(273.15)).alias("t2m_kelvin"),
    )


def with_year(daily: DataFrame) -> DataFrame:
    return daily.withColumn("year", date_year(F.col("date")))


def clean_disasters(df: DataFrame, ordered: bool = True) -> DataFrame:
    clean = qc_clean(df)
    return clean.orderBy("kode_wilayah", "year") if ordered else clean
