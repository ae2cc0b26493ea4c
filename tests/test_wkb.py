"""Binary geometry against bytes that Python packs, and against the text form."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from monsoon.functions import spatial, wkb
from monsoon.sources.tables import Catalog

SQUARE = [(100.0, -8.0), (104.0, -8.0), (104.0, -4.0), (100.0, -4.0), (100.0, -8.0)]
HOLE = [(100.5, -7.5), (101.5, -7.5), (101.5, -6.5), (100.5, -6.5), (100.5, -7.5)]
FAR = [(110.25, -1.0), (111.75, -1.0), (110.25, 0.5), (110.25, -1.0)]


def head(order, kind, srid=None, flags=0):
    code = kind | flags | (0x20000000 if srid else 0)
    return bytes([order == "<"]) + struct.pack(f"{order}I", code) + (struct.pack(f"{order}I", srid) if srid else b"")


def polygon(order, rings, more=(), **kind):
    out = head(order, kind.pop("kind", 3), **kind) + struct.pack(f"{order}I", len(rings))
    for ring in rings:
        out += struct.pack(f"{order}I", len(ring)) + b"".join(struct.pack(f"{order}{2 + len(more)}d", *v, *more) for v in ring)
    return out


def text(polygons):
    return "MULTIPOLYGON (" + ", ".join("(" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in p) + ")" for p in polygons) + ")"


def test_numbers_are_read_and_written_bit_for_bit(spark):
    draw = random.Random(2)
    pairs = [(draw.uniform(-180, 180), draw.uniform(-90, 90)) for _ in range(500)]
    pairs += [(0.0, 1.0), (-1.0, 2.0), (0.1, -0.3), (5e-324, 1.7976931348623157e308), (2.0**-1022, -(2.0**-20)), (1 - 2**-53, 1 + 2**-52)]
    data = [(x, y, bytearray(head(o, 1, s) + struct.pack(f"{o}2d", x, y))) for x, y in pairs for o, s in (("<", None), (">", 4326))]
    df = spark.createDataFrame(data, "x double, y double, g binary")
    got = df.select("x", "y", wkb.point_lon(F.col("g")).alias("lon"), wkb.point_lat(F.col("g")).alias("lat"), "g", wkb.point_wkb(F.col("y"), F.col("x")).alias("w"))
    for r in got.collect():
        assert (r.lon, r.lat) == (r.x, r.y)
        if abs(r.x) > 1e-300 or r.x == 0:
            assert bytes(r.w) == head("<", 1) + struct.pack("<2d", r.x, r.y)


def test_third_and_fourth_numbers_are_skipped(spark):
    points = [
        head("<", 1, 4326, 0x80000000) + struct.pack("<3d", 107.5, -6.25, 9.0),
        head(">", 1001) + struct.pack(">3d", 107.5, -6.25, 9.0),
        head("<", 3001) + struct.pack("<4d", 107.5, -6.25, 9.0, 8.0),
    ]
    df = spark.createDataFrame([(bytearray(p),) for p in points], "g binary")
    got = df.select(wkb.point_lon(F.col("g")), wkb.point_lat(F.col("g"))).collect()
    assert [tuple(r) for r in got] == [(107.5, -6.25)] * 3
    shapes = [polygon("<", [SQUARE, HOLE], (3.0,), flags=0x80000000), polygon(">", [SQUARE, HOLE], (3.0, 4.0), kind=3003)]
    df = spark.createDataFrame([(bytearray(s), text([[SQUARE, HOLE]])) for s in shapes], "g binary, t string")
    for a, b in df.select(wkb.polygon_centroid(F.col("g")), spatial.polygon_centroid(F.col("t"))).collect():
        assert tuple(a) == tuple(b)


def test_polygons_are_those_of_the_text_form(spark):
    data = []
    for polygons in ([[SQUARE]], [[SQUARE, HOLE]], [[SQUARE, HOLE], [FAR]], [[FAR], [SQUARE], [HOLE]]):
        for order, other in (("<", "<"), (">", "<"), ("<", ">")):
            body = b"".join(polygon(other, p) for p in polygons)
            data.append((bytearray(head(order, 6, 4326) + struct.pack(f"{order}I", len(polygons)) + body), text(polygons)))
    data.append((bytearray(polygon(">", [SQUARE, HOLE], srid=4326)), text([[SQUARE, HOLE]])))
    df = spark.createDataFrame(data, "g binary, t string")
    got = df.select(wkb.polygon_centroid(F.col("g")).alias("a"), spatial.polygon_centroid(F.col("t")).alias("b")).collect()
    assert len(got) == 13
    for r in got:
        assert tuple(r.a) == tuple(r.b)


def test_what_is_no_geometry_is_null(spark):
    point, square = head("<", 1) + struct.pack("<2d", 1.0, 2.0), polygon("<", [SQUARE, HOLE])
    nan, far = float("nan"), float("inf")
    odd = [
        None, b"", b"\x01", point[:-1], square[:-1], square[:40], head("<", 2) + struct.pack("<I", 0), b"no geometry at all",
        head("<", 1) + struct.pack("<2d", nan, nan), head("<", 1) + struct.pack("<2d", far, 1.0),
        head("<", 3) + struct.pack("<I", 0), head("<", 6) + struct.pack("<I", 0), polygon("<", [[]]),
        *[(head("<", 6) + struct.pack("<I", 2) + square + square)[:-n] for n in (1, 20, len(square) - 6, len(square) - 3, len(square))],
        head("<", 6) + struct.pack("<I", 1) + point, polygon("<", [SQUARE, [(1.0, 1.0), (nan, 2.0), (1.0, 1.0)]]),
        head("<", 6) + struct.pack("<I", 0xFFFFFFFF), head("<", 3) + struct.pack("<II", 1, 0xFFFFFFFF),
    ]
    df = spark.createDataFrame([(None if o is None else bytearray(o),) for o in odd], "g binary")
    got = df.select(wkb.point_lon(F.col("g")), wkb.point_lat(F.col("g")), wkb.polygon_centroid(F.col("g"))).collect()
    assert [tuple(r) for r in got] == [(None, None, None)] * len(odd)
    assert df.limit(0).select(wkb.polygon_centroid(F.col("g"))).collect() == []


def test_tables_hold_either_form(spark):
    ring = [(F.lit(x), F.lit(y)) for x, y in SQUARE]
    zones = spark.range(1).select("id", wkb.multipolygon_wkb([[ring]]).alias("geom"))
    row = Catalog(spark).rdtr(zones).first()
    assert (row.centroid_lat, row.centroid_lon) == pytest.approx((-6.0, 102.0), abs=1e-12)
    rain = spark.range(1).select("id", wkb.point_wkb(F.lit(-6.5), F.lit(107.25)).alias("geom"))
    row = Catalog(spark).chirps(rain).first()
    assert (row.lat, row.lon) == (-6.5, 107.25)
