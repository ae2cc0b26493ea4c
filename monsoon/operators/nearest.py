"""Exact nearest-point joins in planar degrees.

Two plans with the same answer:

* few right points (their number is checked before anything is sent out): each Arrow batch of
  left coordinates is matched against the points, a narrow step without a shuffle;
* many right points: the points are summarised as a grid tree (4 x 4 cells per level, each node
  with its bounding box and count). The distinct left coordinates walk down the tree one level
  per round, every round an equi-join on the cell; a cell is dropped as soon as a nearer one is
  certain. No pair of far-apart points is ever formed, dense spots are split further, and
  repeated coordinates count once on both sides.

Ties go to the point that is first by ``tie_cols``.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monsoon.functions.spatial import squared_distance
from monsoon.session import cut_lineage, ensure_checkpoint_dir

MAX_BROADCAST_POINTS = 4096
_MAX_BROADCAST_ROWS = 100_000
_LEAF_POINTS = 64
_LEVEL_BITS = 2
_DEEPEST = 15
_SALTS = 16
_CHUNK = 2_000_000


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    payload: Mapping[str, str],
    tie_cols: Sequence[str],
    left_xy: tuple[str, str] = ("lat", "lon"),
    right_xy: tuple[str, str] = ("lat", "lon"),
    distance_col: str | None = None,
    max_broadcast_points: int = MAX_BROADCAST_POINTS,
) -> DataFrame:
    """Add to every left row the payload of its nearest right point.

    ``payload`` maps output names to right columns; ``distance_col`` optionally names the squared
    distance. Right points without coordinates are never nearest; left rows without coordinates
    (or an empty right side) get nulls. Counting the right side is the one eager step.
    """
    points = _unique_points(right, payload, tie_cols, right_xy)
    probe = points.limit(max_broadcast_points + 1).collect()
    if len(probe) <= max_broadcast_points:
        return _match_small(left, probe, points.schema, payload, left_xy, distance_col)
    return _match_large(left, points, payload, left_xy, distance_col)


def _unique_points(right: DataFrame, payload: Mapping[str, str], tie_cols: Sequence[str], xy) -> DataFrame:
    """One row (plat, plon, m) per coordinate; m = (tie, payload) of its first point."""
    lat, lon = (F.col(c).cast("double") for c in xy)
    best = F.struct(
        F.struct(*[F.col(c) for c in tie_cols]).alias("tie"),
        F.struct(*[F.col(src).alias(out) for out, src in payload.items()]).alias("out"),
    )
    # Adding 0.0 turns -0.0 into 0.0, so equal coordinates form one group.
    return (
        right.select((lat + 0.0).alias("plat"), (lon + 0.0).alias("plon"), best.alias("m"))
        .filter(F.col("plat").isNotNull() & F.col("plon").isNotNull())
        .filter(~F.isnan("plat") & ~F.isnan("plon"))
        .groupBy("plat", "plon")
        .agg(F.min("m").alias("m"))
    )


# ---------------------------------------------------------------- few right points


def _position_udf(lats: np.ndarray, lons: np.ndarray):
    @F.pandas_udf("long")
    def position(lat: pd.Series, lon: pd.Series) -> pd.Series:
        x = lat.to_numpy(dtype="float64", na_value=np.nan)
        y = lon.to_numpy(dtype="float64", na_value=np.nan)
        usable = ~(np.isnan(x) | np.isnan(y))
        found = np.full(len(x), -1, dtype="int64")
        spots, back = np.unique(x[usable] + 1j * y[usable], return_inverse=True)
        best = np.empty(len(spots), dtype="int64")
        step = max(1, _CHUNK // max(1, len(lats)))
        for at in range(0, len(spots), step):
            part = spots[at : at + step]
            dlat = lats[None, :] - part.real[:, None]
            dlon = lons[None, :] - part.imag[:, None]
            best[at : at + step] = np.argmin(dlat * dlat + dlon * dlon, axis=1)
        found[usable] = best[back]
        return pd.Series(found)

    return position


def _match_small(left, rows, schema, payload, left_xy, distance_col) -> DataFrame:
    spark = left.sparkSession
    out_type = schema["m"].dataType["out"].dataType
    if not rows:
        out = left.withColumns({f.name: F.lit(None).cast(f.dataType) for f in out_type.fields})
        return out.withColumn(distance_col, F.lit(None).cast("double")) if distance_col else out
    rows = sorted(rows, key=lambda r: tuple(r["m"]["tie"]))
    lats = np.array([r["plat"] for r in rows])
    lons = np.array([r["plon"] for r in rows])
    table = spark.createDataFrame(
        [(i, r["plat"], r["plon"], r["m"]["out"]) for i, r in enumerate(rows)],
        T.StructType(
            [
                T.StructField("__pos", T.LongType()),
                T.StructField("__plat", T.DoubleType()),
                T.StructField("__plon", T.DoubleType()),
                T.StructField("__out", out_type),
            ]
        ),
    )
    lat, lon = (F.col(c).cast("double") for c in left_xy)
    # At most max_broadcast_points rows, checked above.
    joined = left.withColumn("__pos", _position_udf(lats, lons)(lat, lon)).join(
        F.broadcast(table), "__pos", "left"
    )
    extra = {name: F.col("__out")[name] for name in payload}
    if distance_col:
        extra[distance_col] = squared_distance(lat, lon, F.col("__plat"), F.col("__plon"))
    return joined.withColumns(extra).drop("__pos", "__plat", "__plon", "__out")


# ---------------------------------------------------------------- many right points


def _salted_join(many: DataFrame, few: DataFrame, keys: Sequence[str], few_rows: int, how: str = "inner") -> DataFrame:
    """Equi-join where one key may hold a large share of ``many`` but few rows of ``few``."""
    if few_rows <= _MAX_BROADCAST_ROWS:
        return many.join(F.broadcast(few), list(keys), how)
    salted = many.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int"))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def _cell(c: Column, low: float, size: float) -> Column:
    last = (1 << (_LEVEL_BITS * _DEEPEST)) - 1
    return F.least(F.floor((c - low) / size), F.lit(last)).cast("long")


def _gap(at: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - at, at - high, F.lit(0.0))


def _reach(at: Column, low: Column, high: Column) -> Column:
    return F.greatest(at - low, high - at)


def _roll_up(finest: DataFrame) -> DataFrame:
    """The tree's nodes at all depths with their parents (px, py): one pass over the finest cells."""
    by_depth = finest.withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(_DEEPEST))))
    shift = (F.lit(_DEEPEST) - F.col("depth")) * _LEVEL_BITS
    cell = [F.call_function("shiftright", F.col(c), shift).alias(c) for c in ("cx", "cy")]
    rolled = by_depth.groupBy("depth", *cell).agg(
        F.sum("n").alias("n"),
        F.min("lat0").alias("lat0"),
        F.max("lat1").alias("lat1"),
        F.min("lon0").alias("lon0"),
        F.max("lon1").alias("lon1"),
    )
    parent = [F.shiftright(c, _LEVEL_BITS).alias(p) for c, p in (("cx", "px"), ("cy", "py"))]
    return rolled.select(*parent, "*")


class Pyramid:
    """The search tree over the right points: a table that is built once and joined with any number of left frames.

    A folder holds ``points`` (coordinates, finest cell, tie and payload), ``nodes`` by depth, and ``about``: one row with
    the corner and size of the cells. A new version goes to a folder of its own, so readers of the old one aren't disturbed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.points = spark.read.parquet(f"{path}/points")
        about = spark.read.parquet(f"{path}/about").first()
        self.empty = about["size"] is None
        self.nodes = None if self.empty else spark.read.parquet(f"{path}/nodes")
        self.node_rows = dict(about["node_rows"] or {})

    @staticmethod
    def build(right: DataFrame, payload: Mapping[str, str], tie_cols: Sequence[str], path: str, right_xy=("lat", "lon")) -> Pyramid:
        return Pyramid._write(_unique_points(right, payload, tie_cols, right_xy), path)

    @staticmethod
    def _write(unique: DataFrame, path: str) -> Pyramid:
        spark = unique.sparkSession
        unique = cut_lineage(unique)
        ext = unique.agg(
            F.min("plat").alias("lat0"), F.max("plat").alias("lat1"), F.min("plon").alias("lon0"), F.max("plon").alias("lon1")
        ).first()
        size, counts = None, {}
        if ext["lat0"] is None:
            unique.withColumns({c: F.lit(None).cast("long") for c in ("cx", "cy")}).write.parquet(f"{path}/points")
        else:
            extent = max(ext["lat1"] - ext["lat0"], ext["lon1"] - ext["lon0"]) or 1.0
            size = extent / float(1 << (_LEVEL_BITS * _DEEPEST))
            cells = {"cx": _cell(F.col("plat"), ext["lat0"], size), "cy": _cell(F.col("plon"), ext["lon0"], size)}
            unique.withColumns(cells).write.parquet(f"{path}/points")
            finest = spark.read.parquet(f"{path}/points").groupBy("cx", "cy").agg(
                F.count(F.lit(1)).alias("n"),
                F.min("plat").alias("lat0"),
                F.max("plat").alias("lat1"),
                F.min("plon").alias("lon0"),
                F.max("plon").alias("lon1"),
            )
            _roll_up(finest).write.partitionBy("depth").parquet(f"{path}/nodes")
            rows = spark.read.parquet(f"{path}/nodes").groupBy("depth").count().collect()  # one row a depth
            counts = {int(r["depth"]): int(r["count"]) for r in rows}
        # Written last: a folder without it isn't finished.
        about = [(ext["lat0"], ext["lon0"], size, counts)]
        kind = "lat0 double, lon0 double, size double, node_rows map<int, bigint>"
        spark.createDataFrame(about, kind).coalesce(1).write.parquet(f"{path}/about")
        return Pyramid(spark, path)

    def join(self, left: DataFrame, left_xy: tuple[str, str] = ("lat", "lon"), distance_col: str | None = None) -> DataFrame:
        """Every left row with the payload of its nearest point, as ``nearest_join`` gives it."""
        if self.empty:
            return _match_small(left, [], self.points.schema, {}, left_xy, distance_col)
        return _walk(left, self, left_xy, distance_col)


def _match_large(left, points, payload, left_xy, distance_col) -> DataFrame:
    spark = left.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/pyramids/{uuid.uuid4().hex}"
    return Pyramid._write(points, path).join(left, left_xy, distance_col)


def _walk(left: DataFrame, tree: Pyramid, left_xy: tuple[str, str], distance_col: str | None) -> DataFrame:
    """The distinct left coordinates walk down the tree."""
    cells = tree.points
    qlat, qlon = (F.col(c).cast("double") + 0.0 for c in left_xy)
    spots = (
        left.select(qlat.alias("qlat"), qlon.alias("qlon"))
        .filter(F.col("qlat").isNotNull() & F.col("qlon").isNotNull())
        .filter(~F.isnan("qlat") & ~F.isnan("qlon"))
        .distinct()
    )
    zero = F.lit(0).cast("long")
    front = spots.withColumns({"cx": zero, "cy": zero, "n": F.lit(_LEAF_POINTS + 1).cast("long")})
    best: DataFrame | None = None
    for depth in range(1, _DEEPEST + 1):
        children = tree.nodes.filter(F.col("depth") == depth).drop("depth")
        front = _descend(front, children, tree.node_rows.get(depth, 0))
        leaves = front.filter((F.col("n") <= _LEAF_POINTS) | F.lit(depth == _DEEPEST))
        found = _scan_leaves(leaves, cells, depth)
        best = found if best is None else best.unionByName(found)
        best = cut_lineage(_nearest_per_spot(best))
        inner = front.filter(F.col("n") > _LEAF_POINTS) if depth < _DEEPEST else front.limit(0)
        # A spot whose leaf already holds a strictly nearer point needs the cell no more.
        inner = inner.join(best.select("qlat", "qlon", F.col("d2").alias("__d2")), ["qlat", "qlon"], "left")
        front = cut_lineage(
            inner.filter(F.col("__d2").isNull() | (F.col("near") <= F.col("__d2"))).select("qlat", "qlon", "cx", "cy", "n")
        )
        if front.isEmpty():
            break
    mapping = best.select(
        F.col("qlat").alias("__qlat"), F.col("qlon").alias("__qlon"), F.col("m.out").alias("__out"), F.col("d2").alias("__d2")
    )
    keyed = left.withColumns({"__qlat": qlat, "__qlon": qlon})
    joined = _salted_join(keyed, mapping, ["__qlat", "__qlon"], mapping.count(), "left")
    extra = {name: F.col("__out")[name] for name in cells.schema["m"].dataType["out"].dataType.names}
    if distance_col:
        extra[distance_col] = F.col("__d2")
    return joined.withColumns(extra).drop("__qlat", "__qlon", "__out", "__d2")


def _descend(front: DataFrame, children: DataFrame, node_rows: int) -> DataFrame:
    """Replace every open cell by its children and drop those that cannot hold the nearest."""
    opened = front.select("qlat", "qlon", F.col("cx").alias("px"), F.col("cy").alias("py"))
    pairs = _salted_join(opened, children, ["px", "py"], node_rows).select(
        "qlat", "qlon", "cx", "cy", "n", *_bounds()
    )
    limit = pairs.groupBy("qlat", "qlon").agg(F.min("far").alias("limit"))
    kept = pairs.join(limit, ["qlat", "qlon"]).filter(F.col("near") <= F.col("limit"))
    return cut_lineage(kept.select("qlat", "qlon", "cx", "cy", "n", "near"))


def _bounds() -> list[Column]:
    """Squared distance to the nearest and to the farthest point of a node's bounding box."""
    lat, lon = F.col("qlat"), F.col("qlon")
    near_lat, near_lon = _gap(lat, F.col("lat0"), F.col("lat1")), _gap(lon, F.col("lon0"), F.col("lon1"))
    far_lat, far_lon = _reach(lat, F.col("lat0"), F.col("lat1")), _reach(lon, F.col("lon0"), F.col("lon1"))
    return [
        (near_lat * near_lat + near_lon * near_lon).alias("near"),
        (far_lat * far_lat + far_lon * far_lon).alias("far"),
    ]


def _scan_leaves(leaves: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """Distances to the points of leaf cells (at most ``_LEAF_POINTS`` each above the deepest level)."""
    shift = _LEVEL_BITS * (_DEEPEST - depth)
    at_depth = cells.select(
        F.shiftright("cx", shift).alias("cx"), F.shiftright("cy", shift).alias("cy"), "plat", "plon", "m"
    )
    wanted = leaves.select("qlat", "qlon", "cx", "cy")
    used = wanted.select("cx", "cy").distinct()
    in_leaf = at_depth.join(used, ["cx", "cy"], "left_semi")
    salted = wanted.withColumn("__salt", F.pmod(F.xxhash64("qlat", "qlon"), F.lit(_SALTS)).cast("int"))
    copies = in_leaf.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    d2 = squared_distance(F.col("qlat"), F.col("qlon"), F.col("plat"), F.col("plon"))
    return salted.join(copies, ["cx", "cy", "__salt"]).select("qlat", "qlon", d2.alias("d2"), "m")


def _nearest_per_spot(pairs: DataFrame) -> DataFrame:
    """Smallest distance first on the plain number, then the tie rule among the few equals."""
    least = pairs.groupBy("qlat", "qlon").agg(F.min("d2").alias("least"))
    equal = pairs.join(least, ["qlat", "qlon"]).filter(F.col("d2") == F.col("least"))
    return equal.groupBy("qlat", "qlon").agg(F.min("d2").alias("d2"), F.min("m").alias("m"))


# ---------------------------------------------------------------- one query point


def nearest_record(df: DataFrame, lat: float, lon: float, tie_cols: Sequence[str]) -> DataFrame:
    """The one record nearest to a coordinate (a top-1, no full sort)."""
    d2 = squared_distance(F.lit(float(lat)), F.lit(float(lon)), F.col("lat"), F.col("lon"))
    return df.withColumn("d2", d2).filter(F.col("d2").isNotNull()).orderBy("d2", *tie_cols).limit(1)

