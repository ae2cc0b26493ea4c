"""Points, polygons and planar distances. WKT order is (lon, lat)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
_POINT = rf"^\s*(?:SRID=\d+;)?\s*POINT\s*\(\s*({_NUMBER})\s+({_NUMBER})\s*\)\s*$"
_PAIR = rf"({_NUMBER})\s+({_NUMBER})"

KM_PER_DEGREE = 111.0


def point_lon(wkt: Column) -> Column:
    return F.regexp_extract(F.upper(wkt), _POINT, 1).try_cast("double")


def point_lat(wkt: Column) -> Column:
    return F.regexp_extract(F.upper(wkt), _POINT, 2).try_cast("double")


def point_wkt(lat: Column, lon: Column) -> Column:
    """``POINT (lon lat)``, null when either part is null."""
    return F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def squared_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = lat2 - lat1, lon2 - lon1
    return dlat * dlat + dlon * dlon


def degrees_to_km(squared: Column) -> Column:
    return F.sqrt(squared) * F.lit(KM_PER_DEGREE)


def add_spatial_features(df: DataFrame) -> DataFrame:
    return df.withColumn("abs_lat", F.abs(F.col("lat")))


def _ring(text: Column) -> Column:
    """One ring's text -> array of (x, y), shifted later to keep the products small."""
    xs = F.regexp_extract_all(text, F.lit(_PAIR), 1)
    ys = F.regexp_extract_all(text, F.lit(_PAIR), 2)
    return F.arrays_zip(
        F.transform(xs, lambda v: v.cast("double")).alias("x"),
        F.transform(ys, lambda v: v.cast("double")).alias("y"),
    )


def _ring_moments(ring: Column, x0: Column, y0: Column) -> Column:
    """Absolute area and first moments about (x0, y0) by the shoelace sum."""
    edges = F.arrays_zip(
        F.slice(ring, F.lit(1), F.size(ring) - 1).alias("p"),
        F.slice(ring, F.lit(2), F.size(ring) - 1).alias("q"),
    )

    def step(acc: Column, e: Column) -> Column:
        px, py = e["p"]["x"] - x0, e["p"]["y"] - y0
        qx, qy = e["q"]["x"] - x0, e["q"]["y"] - y0
        cross = px * qy - qx * py
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["mx"] + (px + qx) * cross).alias("mx"),
            (acc["my"] + (py + qy) * cross).alias("my"),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def oriented(acc: Column) -> Column:
        sign = F.signum(acc["a"])
        return F.struct(
            (acc["a"] * sign / 2).alias("a"), (acc["mx"] * sign / 6).alias("mx"), (acc["my"] * sign / 6).alias("my")
        )

    return F.aggregate(edges, zero, step, oriented)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may read it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def polygon_centroid(wkt: Column) -> Column:
    """Struct (lat, lon): area centroid of a POLYGON or MULTIPOLYGON, holes taken away; null for null.

    Coordinates are shifted to the first vertex before the products, so small polygons far
    from the origin lose no digits.
    """
    # A ring that opens right after its polygon is the shell; the others are holes.
    flat = F.regexp_replace(F.upper(wkt), r"^\s*(?:SRID=\d+;)?\s*(?:MULTI)?POLYGON\s*", "")
    marked = F.regexp_replace(flat, r"\(\s*\(\s*(?=[-+.0-9])", "(S")
    ring_texts = F.filter(F.split(marked, r"[()]"), lambda t: t.rlike(r"[0-9]"))
    rings = F.transform(
        ring_texts, lambda t: F.struct(t.startswith("S").alias("shell"), _ring(t).alias("pts"))
    )
    return _bind(rings, _rings_centroid)


def _rings_centroid(rings: Column) -> Column:
    def around(first: Column) -> Column:
        def add(acc: Column, r: Column) -> Column:
            sign = F.when(r["shell"], 1.0).otherwise(-1.0)
            moments = _bind(r["pts"], lambda pts: _ring_moments(pts, first["x"], first["y"]))
            return _bind(
                moments,
                lambda m: F.struct(
                    (acc["a"] + sign * m["a"]).alias("a"),
                    (acc["mx"] + sign * m["mx"]).alias("mx"),
                    (acc["my"] + sign * m["my"]).alias("my"),
                ),
            )

        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

        def finish(total: Column) -> Column:
            area = F.nullif(total["a"], F.lit(0.0))
            return F.struct(
                (first["y"] + total["my"] / area).alias("lat"), (first["x"] + total["mx"] / area).alias("lon")
            )

        return F.aggregate(rings, zero, add, finish)

    return _bind(F.element_at(F.element_at(rings, 1)["pts"], 1), around)
