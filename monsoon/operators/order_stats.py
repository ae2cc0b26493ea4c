"""Exact order statistics without sorting or shuffling the data.

Each pass counts rows per value interval with a map-side aggregate (a few thousand small rows
come back), keeps only the interval that holds the wanted rank, and repeats inside it. When an
interval holds few rows its values are read. So no task ever holds a whole column, a value
shared by a third of all rows is one counter, and the answer is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BINS = 2048
_READ_AT_MOST = 2000


@dataclass
class Summary:
    count: int
    low: float | int
    high: float | int


@dataclass
class _Interval:
    group: object
    low: float | int
    high: float | int
    below: int
    count: int
    ranks: list[int] = field(default_factory=list)


def summaries(df: DataFrame, value: str, group: str | None = None) -> dict[object, Summary]:
    """Count, smallest and largest non-null value per group (group None: the whole column)."""
    key = F.lit(None).cast("string") if group is None else F.col(group)
    rows = (
        df.select(key.alias("g"), F.col(value).alias("v"))
        .filter(F.col("v").isNotNull())
        .groupBy("g")
        .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    )
    return {r["g"]: Summary(r["n"], r["lo"], r["hi"]) for r in rows}


def _interval_id(intervals: Sequence[_Interval], grouped: bool) -> Column:
    out = None
    for i, t in enumerate(intervals):
        hit = (F.col("v") >= F.lit(t.low)) & (F.col("v") <= F.lit(t.high))
        if grouped:
            hit = F.col("g").eqNullSafe(F.lit(t.group)) & hit
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out


def _per_interval(i: Column, values: Iterable) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)


def select_ranks(
    df: DataFrame,
    value: str,
    ranks: Mapping[object, Iterable[int]],
    group: str | None = None,
    known: Mapping[object, Summary] | None = None,
) -> dict[tuple[object, int], float | int]:
    """The value at each 0-based rank of each group, nulls left out."""
    known = summaries(df, value, group) if known is None else known
    key = F.lit(None).cast("string") if group is None else F.col(group)
    base = df.select(key.alias("g"), F.col(value).alias("v"))
    found: dict[tuple[object, int], float | int] = {}
    open_: list[_Interval] = []
    for g, wanted in ranks.items():
        s = known[g]
        wanted = sorted(set(wanted))
        if wanted and not (0 <= wanted[0] and wanted[-1] < s.count):
            raise ValueError(f"rank outside 0..{s.count - 1}")
        if wanted:
            open_.append(_Interval(g, s.low, s.high, 0, s.count, wanted))
    while open_:
        still = []
        for t in open_:
            if t.low == t.high:
                found.update({(t.group, r): t.low for r in t.ranks})
            else:
                still.append(t)
        small = [t for t in still if t.count <= _READ_AT_MOST]
        large = [t for t in still if t.count > _READ_AT_MOST]
        if small:
            _read_small(base, small, group is not None, found)
        open_ = _narrow(base, large, group is not None) if large else []
    return found


def _read_small(base: DataFrame, intervals: list[_Interval], grouped: bool, found: dict) -> None:
    rows = (
        base.select(_interval_id(intervals, grouped).alias("i"), "v")
        .filter(F.col("i").isNotNull())
        .groupBy("i", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    per: dict[int, list] = {}
    for r in rows:
        per.setdefault(r["i"], []).append((r["v"], r["n"]))
    for i, t in enumerate(intervals):
        values = sorted(per[i])
        pos, below = 0, t.below
        for rank in t.ranks:
            while below + values[pos][1] <= rank:
                below += values[pos][1]
                pos += 1
            found[(t.group, rank)] = values[pos][0]


def _narrow(base: DataFrame, intervals: list[_Interval], grouped: bool) -> list[_Interval]:
    i = F.col("i")
    offset = (F.col("v") - _per_interval(i, [t.low for t in intervals])).cast("double")
    # Monotone in v, so every value of a lower bin is below every value of a higher one.
    width = [float(t.high - t.low) for t in intervals]
    share = offset / _per_interval(i, width)
    rows = (
        base.select(_interval_id(intervals, grouped).alias("i"), "v")
        .filter(i.isNotNull())
        .select(i, "v", F.floor(share * F.lit(float(_BINS))).alias("bin"))
        .groupBy("i", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    )
    per: dict[int, list] = {}
    for r in rows:
        per.setdefault(r["i"], []).append((r["bin"], r["n"], r["lo"], r["hi"]))
    out = []
    for k, t in enumerate(intervals):
        below = t.below
        for _, n, lo, hi in sorted(per[k]):
            inside = [r for r in t.ranks if below <= r < below + n]
            if inside:
                out.append(_Interval(t.group, lo, hi, below, n, inside))
            below += n
    return out


def quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], computed: bool = False
) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbouring ranks.

    ``computed`` marks a column that is costly to derive: its numbers are kept between the
    passes (in memory, spilling to disk). A stored column is simply scanned again.
    """
    if not computed:
        return column_quantiles(df, [value], probabilities)[value]
    kept = df.select(value).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return column_quantiles(kept, [value], probabilities)[value]
    finally:
        kept.unpersist()


def column_quantiles(
    df: DataFrame, values: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list[float | None]]:
    """Exact quantiles of several numeric columns, all columns in the same passes."""
    if len(values) == 1:
        stacked = df.select(F.lit(values[0]).alias("g"), F.col(values[0]).cast("double").alias("v"))
    else:
        pairs = F.array(
            *[F.struct(F.lit(c).alias("g"), F.col(c).cast("double").alias("v")) for c in values]
        )
        stacked = df.select(F.inline(pairs))
    known = summaries(stacked, "v", "g")
    wanted: dict[object, set[int]] = {}
    for c, s in known.items():
        for p in probabilities:
            position = p * (s.count - 1)
            wanted.setdefault(c, set()).update({math.floor(position), math.ceil(position)})
    found = select_ranks(stacked, "v", wanted, "g", known)
    out: dict[str, list[float | None]] = {}
    for c in values:
        if c not in known:
            out[c] = [None] * len(probabilities)
            continue
        out[c] = []
        for p in probabilities:
            position = p * (known[c].count - 1)
            lo, hi = found[(c, math.floor(position))], found[(c, math.ceil(position))]
            out[c].append(lo + (hi - lo) * (position - math.floor(position)))
    return out
