"""Per-row attributions of MLlib tree ensembles (path-dependent Shapley values).

For a leaf with path features j, cover shares z_j and hits o_j (0 or 1), the Shapley value of
feature i is  v * (o_i - z_i) * integral over t in (0, 1) of  prod_{j != i} (z_j (1-t) + o_j t).
The integrand is a polynomial, so a few Gauss-Legendre nodes give it exactly.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monsoon.functions.rounding import SPLIT


@dataclass
class Leaf:
    """Path of one leaf: per feature its cover share and the tests a row must pass."""

    value: np.ndarray
    features: list[int]
    shares: np.ndarray
    tests: list[list[tuple]]


def read_leaves(spark: SparkSession, model_path: str, weights: Sequence[float]) -> tuple[list[Leaf], np.ndarray]:
    """Leaves of a saved ensemble, values already weighted, and the expected prediction.

    ``weights`` are the model's tree weights. Node tables are as small as the model itself.
    """
    about = json.loads(spark.read.text(f"{model_path}/metadata").first()["value"])
    classify = "Classification" in about["class"]
    trees: dict[int, dict] = defaultdict(dict)
    for r in spark.read.parquet(f"{model_path}/data").select("treeID", "nodeData.*").collect():
        trees[r["treeID"]][r["id"]] = r
    scale = {t: (1.0 / len(trees) if "RandomForest" in about["class"] else float(weights[t])) for t in trees}
    leaves: list[Leaf] = []
    expected: np.ndarray | float = 0.0

    def value(r, w: float) -> np.ndarray:
        stats = np.asarray(r["impurityStats"], dtype="float64")
        return w * (stats / stats.sum()) if classify else np.array([w * r["prediction"]])

    def cover(r) -> float:
        return float(sum(r["impurityStats"])) if classify else float(r["impurityStats"][0])

    for t, nodes in trees.items():
        stack = [(nodes[0], 1.0, {})]
        while stack:
            r, reach, path = stack.pop()
            if r["leftChild"] < 0:
                leaves.append(
                    Leaf(
                        value(r, scale[t]),
                        list(path),
                        np.array([p[0] for p in path.values()]),
                        [p[1] for p in path.values()],
                    )
                )
                expected = expected + reach * leaves[-1].value
                continue
            split, f = r["split"], r["split"]["featureIndex"]
            category = split["numCategories"] != -1
            limit = list(split["leftCategoriesOrThreshold"])
            for child, is_left in ((nodes[r["leftChild"]], True), (nodes[r["rightChild"]], False)):
                share = cover(child) / cover(r)
                old_share, old_tests = path.get(f, (1.0, []))
                test = (category, tuple(limit), is_left)
                stack.append((child, reach * share, {**path, f: (old_share * share, [*old_tests, test])}))
    return leaves, np.asarray(expected)


def _passes(x: np.ndarray, tests: Sequence[tuple]) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for category, limit, is_left in tests:
        left = np.isin(x, limit) if category else x <= limit[0]
        ok &= left if is_left else ~left
    return ok


@lru_cache(maxsize=64)
def _quadrature(n: int) -> tuple[np.ndarray, np.ndarray]:
    nodes, weights = np.polynomial.legendre.leggauss(n)
    return (nodes + 1) / 2, weights / 2


def _distinct(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and each row's position among them; by counting while the codes are few."""
    if bits > 14:
        return np.unique(code, return_inverse=True)
    patterns = np.flatnonzero(np.bincount(code, minlength=1 << bits))
    slot = np.empty(1 << bits, dtype="int64")
    slot[patterns] = np.arange(len(patterns))
    return patterns, slot[code]


#: Up to so many path features all hit patterns of a leaf are worked out beforehand, for so many numbers in all.
_TABLE_FEATURES = 10
_TABLE_NUMBERS = 8_000_000
#: Leaves whose contributions are added up at once.
_BLOCK = 64
#: Rows looked up at once, which bounds the memory.
_CHUNK = 8192


def _weights_of(hit: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Per path feature (rows) and hit pattern (columns of ``hit``) the Shapley value at a leaf of value 1."""
    t, w = _quadrature((len(shares) + 1) // 2)
    factors = shares[:, None, None] * (1 - t)[None, :, None] + hit[:, None, :] * t[None, :, None]
    rest = (w[None, :, None] * factors.prod(axis=0)[None] / factors).sum(axis=1)
    return (hit - shares[:, None]) * rest


def _hits(patterns: np.ndarray, m: int) -> np.ndarray:
    return (patterns[None, :] >> np.arange(m)[:, None]) & 1


class _States:
    """What the tests of a feature can tell apart: where a value lies among their thresholds and their categories."""

    def __init__(self, tests: Sequence[tuple]):
        self.thresholds = np.unique([limit[0] for category, limit, _ in tests if not category]).astype("float64")
        self.categories = np.unique([c for category, limit, _ in tests if category for c in limit]).astype("float64")
        kinds = len(self.categories) + 1
        self._above, self._kind = np.divmod(np.arange((len(self.thresholds) + 1) * kinds), kinds)

    def of(self, x: np.ndarray) -> np.ndarray:
        above = np.searchsorted(self.thresholds, x, side="left")  # NaN lies above all thresholds
        if not len(self.categories):
            return above.astype(np.intp, copy=False)
        at = np.minimum(np.searchsorted(self.categories, x, side="left"), len(self.categories) - 1)
        kind = np.where(self.categories[at] == x, at, len(self.categories))
        return above * (len(self.categories) + 1) + kind

    def passing(self, tests: Sequence[tuple]) -> np.ndarray:
        """For each state whether a value passes all tests."""
        ok = np.ones(len(self._above), dtype=bool)
        for category, limit, is_left in tests:
            if category:
                left = np.isin(self._kind, np.searchsorted(self.categories, limit))
            else:
                left = self._above <= np.searchsorted(self.thresholds, limit[0])
            ok &= left if is_left else ~left
        return ok


class Explainer:
    """Attributions of one ensemble; what doesn't depend on the rows is worked out once.

    At one leaf a row matters only by which path features it hits. A feature's tests tell few states apart, so a row's hits
    are looked up by its states, and its contributions by its hits.
    """

    def __init__(self, leaves: Sequence[Leaf], outputs: int):
        self.outputs = outputs
        leaves = [leaf for leaf in leaves if leaf.features]
        seen: dict[int, list[tuple]] = defaultdict(list)
        for leaf in leaves:
            for f, tests in zip(leaf.features, leaf.tests, strict=True):
                seen[f].extend(tests)
        self._states = {f: _States(tests) for f, tests in seen.items()}
        # Leaves of deep trees are many, but the tests of one feature differ in few ways.
        known: dict[tuple, np.ndarray] = {}

        def bit(j: int, f: int, tests: Sequence[tuple]) -> np.ndarray:
            key = (j, f, tuple(tests))
            if key not in known:
                known[key] = self._states[f].passing(tests).astype(np.intp) << j
            return known[key]

        bits = [[bit(j, f, tests) for j, (f, tests) in enumerate(zip(leaf.features, leaf.tests, strict=True))] for leaf in leaves]
        tables, room = [], _TABLE_NUMBERS
        for leaf in leaves:
            m = len(leaf.features)
            fits = m <= _TABLE_FEATURES and m << m <= room
            room -= m << m if fits else 0
            tables.append(_weights_of(_hits(np.arange(1 << m), m), leaf.shares) if fits else None)
        self._blocks = []
        for start in range(0, len(leaves), _BLOCK):
            own = range(start, min(start + _BLOCK, len(leaves)))
            rows: dict[int, int] = defaultdict(int)
            steps, values, before = [], defaultdict(list), []
            for i in own:
                places = []
                path = [(f, tuple(tests)) for f, tests in zip(leaves[i].features, leaves[i].tests, strict=True)]
                # Neighbouring leaves share the start of their paths, whose hits are looked up once.
                same = next((j for j, (a, b) in enumerate(zip(path, before, strict=False)) if a != b), min(len(path), len(before)))
                before = path
                for f in leaves[i].features:
                    places.append((f, rows[f]))
                    rows[f] += 1
                    values[f].append(leaves[i].value)
                steps.append((leaves[i].shares, places, same, bits[i], tables[i]))
            self._blocks.append((dict(rows), {f: np.array(v).T for f, v in values.items()}, steps))

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """Attributions (features, outputs, rows) of a feature matrix."""
        phi = np.zeros((x.shape[1], self.outputs, len(x)))
        for at in range(0, len(x), _CHUNK):
            self._add(x[at : at + _CHUNK], phi[:, :, at : at + _CHUNK])
        return phi

    def _add(self, x: np.ndarray, phi: np.ndarray) -> None:
        n = len(x)
        states = {f: s.of(np.ascontiguousarray(x[:, f])) for f, s in self._states.items()}
        deepest = max((len(step[1]) for _, _, steps in self._blocks for step in steps), default=0)
        codes = np.empty((deepest, n), dtype=np.intp)
        room = np.empty((max((sum(rows.values()) for rows, _, _ in self._blocks), default=0), n))
        for rows, values, steps in self._blocks:
            ends = np.cumsum(list(rows.values()))
            parts = {f: room[end - count : end] for (f, count), end in zip(rows.items(), ends, strict=True)}
            for shares, places, same, bits, table in steps:
                for j in range(same, len(places)):
                    bits[j].take(states[places[j][0]], out=codes[j], mode="clip")
                    if j:
                        codes[j] += codes[j - 1]
                code = codes[len(places) - 1]
                if table is None:
                    # Too many patterns to list: those that occur.
                    patterns, code = _distinct(code, len(shares))
                    table = _weights_of(_hits(patterns, len(shares)), shares)
                for (f, at), row in zip(places, table, strict=True):
                    row.take(code, out=parts[f][at], mode="clip")
            for f, part in parts.items():
                phi[f] += values[f] @ part


def shapley(x: np.ndarray, leaves: Sequence[Leaf], outputs: int) -> np.ndarray:
    """Attributions (rows, features, outputs) of a feature matrix."""
    return Explainer(leaves, outputs).attributions(x).transpose(2, 0, 1)


def attribution_column(leaves: Sequence[Leaf], outputs: int, features: str = "features") -> Column:
    """Absolute attribution per feature slot, added up over the outputs (classes)."""
    held: list[Explainer] = []

    @F.arrow_udf("array<double>")
    def attribute(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.list_(pa.float64()))
        if not held:
            held.append(Explainer(leaves, outputs))
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        sums = np.ascontiguousarray(np.abs(held[0].attributions(x)).sum(axis=1).T)
        ends = np.arange(0, sums.size + 1, sums.shape[1], dtype="int32")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel()))

    return attribute(vector_to_array(features))


def _rounded(c: np.ndarray, digits: int) -> np.ndarray:
    """``round_scalar`` of many numbers, step by step the same."""
    scale = float(10**digits)
    with np.errstate(invalid="ignore", over="ignore"):
        head = c * SPLIT - (c * SPLIT - c)
        low = np.floor(c * scale) + 0.0
        above_mid = (head * scale - (low + 0.5)) + (c - head) * scale
        up = (above_mid > 0) | ((above_mid == 0) & (low % 2 != 0))
        return np.where(np.abs(c) < 2.0**52 / scale, (low + up) / scale, c)


def _slots(raw: pa.Array, width: int) -> np.ndarray:
    """The first entries of lists as a matrix; absent and null ones are 0."""
    out = np.zeros((len(raw), width))
    sizes = np.fromiter((n or 0 for n in raw.value_lengths().to_pylist()), "int64", len(raw)) if raw.null_count else raw.value_lengths().to_numpy()
    flat = raw.flatten()
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy(zero_copy_only=False)
    if len(raw) and (sizes == sizes[0]).all():
        held = min(width, int(sizes[0]))
        out[:, :held] = values.reshape(len(raw), -1)[:, :held] if held else 0.0
        return out
    starts = np.cumsum(sizes) - sizes
    for j in range(width):
        has = sizes > j
        out[has, j] = values[starts[has] + j]
    return out


def add_top_groups(df: DataFrame, raw: str, groups: Sequence[str], top: int = 5, name: str = "shap") -> DataFrame:
    """Add an array of (f, w, raw): slots added up per display group, largest first, share of the total.

    Worked out for a batch at once: a row's few groups cost less there than as an array of its own with functions over it.
    """
    names = list(dict.fromkeys(groups))
    own = [[slot for slot, group in enumerate(groups) if group == group_name] for group_name in names]
    kept = min(top, len(names))

    @F.arrow_udf("array<struct<f: string, w: double, raw: double>>")
    def ranked(lists: pa.Array) -> pa.Array:
        slots = _slots(lists, len(groups))
        minus = np.empty((len(lists), len(names)))
        for i, places in enumerate(own):
            total = np.zeros(len(lists))
            for place in places:
                total = total + slots[:, place]
            minus[:, i] = -total
        order = np.argsort(minus, axis=1, kind="stable")  # ties go to the first group
        minus = np.take_along_axis(minus, order, axis=1)
        whole = np.zeros(len(lists))
        for i in range(len(names)):
            whole = whole - minus[:, i]
        whole[whole == 0] = 1.0
        first = -minus[:, :kept]
        entries = [
            pa.array(names, pa.string()).take(pa.array(order[:, :kept].ravel())),
            pa.array(_rounded(first / whole[:, None], 4).ravel()),
            pa.array(_rounded(first, 6).ravel()),
        ]
        ends = pa.array(np.arange(len(lists) + 1, dtype="int32") * kept, pa.int32())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(entries, ["f", "w", "raw"]))

    return df.withColumn(name, ranked(F.col(raw).cast("array<double>")))


def with_attributions(
    transformed: DataFrame, model_path: str, weights: Sequence[float], groups: Sequence[str], top: int = 5
) -> DataFrame:
    """Add ``shap`` to rows that already carry the model's feature vector."""
    leaves, expected = read_leaves(transformed.sparkSession, model_path, weights)
    out = transformed.withColumn("__raw", attribution_column(leaves, len(expected)))
    return add_top_groups(out, "__raw", groups, top).drop("__raw")
