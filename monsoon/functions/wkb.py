"""Points and polygons in binary form (WKB and its extended and ISO variants), read and written by built-in functions.

Both byte orders, ids of reference systems, and third and fourth dimensions (which are skipped) are read. Numbers come out
bit for bit. Defined results: null for null, for other kinds of geometry, for empty geometries, for coordinates that are not
finite, and for bytes that end too early. Text of hexadecimal digits has to go through ``unhex`` first.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from monsoon.functions.spatial import _bind, _rings_centroid

_POINT, _POLYGON, _MULTIPOLYGON = 1, 3, 6
_SRID, _Z, _M = 0x20000000, 0x80000000, 0x40000000
_LATIN = "ISO-8859-1"


def _turned(raw: Column) -> Column:
    """The bytes in opposite order: one letter a byte, reversed."""
    return F.encode(F.reverse(F.decode(raw, _LATIN)), _LATIN)


def _digits(data: Column, at: Column, size: int, little: Column) -> Column:
    raw = F.substr(data, at.cast("int"), F.lit(size))
    return F.when(F.length(raw) == size, F.hex(F.when(little, _turned(raw)).otherwise(raw)))


def _whole(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _count(data: Column, at: Column, little: Column) -> Column:
    return _whole(_digits(data, at, 4, little))


def _double(data: Column, at: Column, little: Column) -> Column:
    """Sign and exponent are the first three digits, the fraction the other thirteen."""

    def value(digits: Column) -> Column:
        def parts(top: Column) -> Column:
            exponent = top.bitwiseAND(F.lit(2047))
            fraction = _whole(F.substr(digits, F.lit(4), F.lit(13)))
            fraction = F.when(exponent == 0, fraction).otherwise(fraction + (1 << 52)).cast("double")
            sign = F.when(top >= 2048, -1.0).otherwise(1.0)
            # A product with a power of two loses nothing.
            return F.when(exponent < 2047, sign * fraction * F.pow(F.lit(2.0), F.greatest(exponent, F.lit(1)) - 1075))

        return _bind(_whole(F.substr(digits, F.lit(1), F.lit(3))), parts)

    return _bind(_digits(data, at, 8, little), value)


def _head(data: Column, at: Column) -> Column:
    """Byte order, kind, numbers a vertex and place of the content of the geometry at a place."""
    little = F.hex(F.substr(data, at.cast("int"), F.lit(1))) == "01"

    def read(code: Column) -> Column:
        plain = code.bitwiseAND(F.lit(0x0FFFFFFF))
        more = F.floor(plain / 1000)
        has_z = (code.bitwiseAND(F.lit(_Z)) != 0) | more.isin(1, 3)
        has_m = (code.bitwiseAND(F.lit(_M)) != 0) | more.isin(2, 3)
        return F.struct(
            little.alias("little"),
            (plain % 1000).alias("kind"),
            (has_z.cast("int") + has_m.cast("int") + 2).alias("numbers"),
            (at + 5 + F.when(code.bitwiseAND(F.lit(_SRID)) != 0, 4).otherwise(0)).cast("long").alias("at"),
        )

    return _bind(_count(data, at + 1, little), read)


def _numbered(count: Column, least_bytes: int, data: Column) -> Column:
    """1 .. count; null where so many parts can't stand in the bytes."""
    none = F.when(count == 0, F.array().cast("array<long>"))
    return none.when(count * least_bytes <= F.length(data), F.sequence(F.lit(1).cast("long"), count))


def _point(data: Column) -> Column:
    def read(head: Column) -> Column:
        x, y = (_double(data, head["at"] + shift, head["little"]) for shift in (0, 8))
        point = F.struct(x.alias("lon"), y.alias("lat"))
        return F.when(head["kind"] == _POINT, F.when(point["lon"].isNotNull() & point["lat"].isNotNull(), point))

    return _bind(_head(data, F.lit(1)), read)


def point_lon(data: Column) -> Column:
    return _point(data)["lon"]


def point_lat(data: Column) -> Column:
    return _point(data)["lat"]


_RING = "struct<shell:boolean,at:bigint,n:bigint,little:boolean,numbers:int>"


def _polygon_rings(data: Column, state: Column) -> Column:
    """``state`` (place, rings so far) moved past the polygon at its place."""

    def read(head: Column) -> Column:
        def ring(acc: Column, number: Column) -> Column:
            def moved(n: Column) -> Column:
                start = acc["at"] + 4
                found = F.struct(
                    (number == 1).alias("shell"), start.alias("at"), n.alias("n"), head["little"].alias("little"),
                    head["numbers"].cast("int").alias("numbers"),
                ).cast(_RING)
                return F.struct(
                    (start + n * head["numbers"] * 8).alias("at"), F.concat(acc["rings"], F.array(found)).alias("rings")
                )

            return _bind(_count(data, acc["at"], head["little"]), moved)

        first = F.struct((head["at"] + 4).cast("long").alias("at"), state["rings"].alias("rings"))
        rings = _numbered(_count(data, head["at"], head["little"]), 4, data)
        return F.when(head["kind"] == _POLYGON, F.aggregate(rings, first, ring))

    return _bind(_head(data, state["at"]), read)


def polygon_centroid(data: Column) -> Column:
    """Struct (lat, lon): area centroid of a polygon or several, holes taken away, as ``spatial.polygon_centroid`` has it."""

    def rings_of(head: Column) -> Column:
        none = F.array().cast(f"array<{_RING}>")
        one = _polygon_rings(data, F.struct(F.lit(1).cast("long").alias("at"), none.alias("rings")))
        start = F.struct((head["at"] + 4).cast("long").alias("at"), none.alias("rings"))
        parts = _numbered(_count(data, head["at"], head["little"]), 9, data)
        many = F.aggregate(parts, start, lambda acc, _: _polygon_rings(data, acc))
        return F.when(head["kind"] == _POLYGON, one["rings"]).when(head["kind"] == _MULTIPOLYGON, many["rings"])

    def vertices(ring: Column) -> Column:
        def vertex(i: Column) -> Column:
            at = ring["at"] + (i - 1) * ring["numbers"] * 8
            return F.struct(
                _double(data, at, ring["little"]).alias("x"), _double(data, at + 8, ring["little"]).alias("y")
            )

        points = F.transform(_numbered(ring["n"], 16, data), vertex)
        return F.struct(ring["shell"].alias("shell"), points.alias("pts"))

    def centre(rings: Column) -> Column:
        bad = F.exists(
            rings,
            lambda r: r["pts"].isNull() | F.exists(r["pts"], lambda p: p["x"].isNull() | p["y"].isNull()),
        )
        return F.when((F.size(rings) > 0) & ~bad, _rings_centroid(rings))

    def with_points(rings: Column) -> Column:
        filled = F.transform(
            F.filter(rings, lambda r: r["n"].isNull() | (r["n"] != 0)),
            vertices,
        )
        return _bind(filled, centre)

    return _bind(_bind(_head(data, F.lit(1)), rings_of), with_points)


# ---------------------------------------------------------------- writing


def _little(number: Column, size: int) -> Column:
    return _turned(F.unhex(F.substr(F.lpad(F.hex(number), 16, "0"), F.lit(17 - 2 * size), F.lit(2 * size))))


def _bits(value: Column) -> Column:
    """The eight bytes of a double, low ones first; values nearer to zero than 2^-1022 become 0, null if not finite."""
    size = F.abs(value.cast("double"))

    def scaled(guess: Column) -> Column:
        fraction = size / F.pow(F.lit(2.0), guess)
        # The logarithm may be a hair off at powers of two.
        exponent = guess + F.when(fraction >= 2, 1).when(fraction < 1, -1).otherwise(0)
        fraction = size / F.pow(F.lit(2.0), exponent)
        whole = ((fraction - 1) * float(1 << 52)).cast("long") + (exponent.cast("long") + 1023) * (1 << 52)
        return _little(F.when(value < 0, whole.bitwiseOR(F.lit(-(1 << 63)))).otherwise(whole), 8)

    finite = ~F.isnan(size) & (size < float("inf"))
    number = _bind(F.floor(F.log2(size)), scaled)
    return F.when(finite & (size < 2.0**-1022), F.unhex(F.lit("00" * 8))).when(finite, number)


def point_wkb(lat: Column, lon: Column) -> Column:
    """A point in little-endian WKB; null when either part is null."""
    return F.concat(F.unhex(F.lit("0101000000")), _bits(lon), _bits(lat))


def multipolygon_wkb(polygons: Sequence[Sequence[Sequence[tuple[Column, Column]]]]) -> Column:
    """Polygons of rings of (lon, lat) vertices, each ring closed; the first ring of a polygon is its shell."""

    def count(n: int) -> Column:
        return F.unhex(F.lit(n.to_bytes(4, "little").hex()))

    parts = [F.unhex(F.lit("0106000000")), count(len(polygons))]
    for rings in polygons:
        parts += [F.unhex(F.lit("0103000000")), count(len(rings))]
        for ring in rings:
            parts += [count(len(ring)), *[_bits(c) for vertex in ring for c in vertex]]
    return functools.reduce(lambda a, b: F.concat(a, b), parts)
