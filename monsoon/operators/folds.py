"""Cross-validation folds: contiguous, stratified contiguous, and hashed.

Contiguous folds follow the row order of a frame. Their borders are order statistics of the
order column, so assigning a fold is a narrow projection: no global sort, no row numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monsoon.operators.order_stats import select_ranks, summaries
from monsoon.session import cut_lineage


#: Up to so many classes the borders of all of them become conditions of one projection.
_FEW_CLASSES = 100


def hashed_folds(df: DataFrame, k: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Reproducible pseudo-random folds from the row key: the cheapest choice on large tables."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(k)).cast("int"))


def with_order_column(df: DataFrame, order: Sequence[str], name: str = "row_order") -> DataFrame:
    """An increasing number along a sort order, for frames whose key is not one number."""
    ordered = df.orderBy(*order).withColumn(name, F.monotonically_increasing_id())
    return cut_lineage(ordered)


def with_unique_order(df: DataFrame, order: str, name: str = "__order") -> tuple[DataFrame, str]:
    """The frame and a column that orders it without ties: ``order`` itself where its values are all different.

    Rows with equal values are put in the order of their other columns.
    """
    seen = df.agg(F.count(order).alias("n"), F.count_distinct(order).alias("d")).first()
    if seen["n"] == seen["d"]:
        return df, order
    plain = [c for c, t in df.dtypes if c != order and not t.startswith(("map", "variant"))]
    return with_order_column(df, [order, *sorted(plain)], name), name


def row_numbers(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Consecutive numbers from 0 along a sort order, by a range-partitioned sort and one offset per partition."""
    placed = with_order_column(df, order, "__place")
    part, inside = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # One row per partition of the sort.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    numbered = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return numbered.withColumn(name, F.col("__offset") + inside).drop("__place", "__part", "__offset")


def fold_sizes(n: int, k: int) -> list[int]:
    return [n // k + (1 if i < n % k else 0) for i in range(k)]


def _fold_from_borders(order: Column, borders: Sequence) -> Column:
    fold = F.lit(0)
    for b in borders:
        fold = fold + (order >= F.lit(b)).cast("int")
    return fold


def _starts(sizes: Sequence[int]) -> list[int]:
    """Rank of the first row of folds 1..k-1 (ranks past the end are left out)."""
    total, at, out = sum(sizes), 0, []
    for size in sizes[:-1]:
        at += size
        out.append(at)
    return [a for a in out if a < total]


def contiguous_folds(df: DataFrame, k: int, order: str) -> DataFrame:
    """Add ``fold`` 0..k-1: consecutive blocks along a numeric order column; ties go by the other columns."""
    df, own = with_unique_order(df, order)
    out = _contiguous(df, k, own)
    return out if own == order else out.drop(own)


def _contiguous(df: DataFrame, k: int, order: str) -> DataFrame:
    known = summaries(df, order)
    if not known:
        raise ValueError("no rows to split into folds")
    n = known[None].count
    if n < k:
        raise ValueError(f"{n} rows cannot fill {k} folds")
    ranks = _starts(fold_sizes(n, k))
    found = select_ranks(df, order, {None: ranks}, known=known)
    return df.withColumn("fold", _fold_from_borders(F.col(order), [found[(None, r)] for r in ranks]))


def stratified_sizes(counts: Sequence[int], k: int) -> list[list[int]]:
    """Rows per fold for each class, classes laid end to end and dealt out in turn."""
    out, start = [], 0
    for n in counts:
        end = start + n
        out.append([len(range(start + (i - start) % k, end, k)) for i in range(k)])
        start = end
    return out


def stratified_folds(df: DataFrame, k: int, target: str, order: str) -> DataFrame:
    """Add ``fold``: within each class consecutive blocks, class shares equal across folds.

    Classes are taken in the order in which they first appear along the order column. Many classes are
    numbered by one sort and joined with their sizes; few need no shuffle of the rows at all.
    """
    df, own = with_unique_order(df, order)
    many = df.select(target).distinct().limit(_FEW_CLASSES + 1).count() > _FEW_CLASSES
    out = _stratified_by_number(df, k, target, own) if many else _stratified(df, k, target, own)
    return out if own == order else out.drop(own)


def _stratified_by_number(df: DataFrame, k: int, target: str, order: str) -> DataFrame:
    numbered = row_numbers(df, [target, order], "__number")
    found = numbered.groupBy(F.col(target).alias("__class")).agg(
        F.min(order).alias("__low"), F.min("__number").alias("__begin"), F.count("*").alias("__size")
    )
    # One row per class: laid end to end in the order in which they appear.
    laid = row_numbers(found, ["__low"], "__at")
    ends = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = laid.withColumn("__end", F.sum("__size").over(ends)).withColumn("__start", F.col("__end") - F.col("__size"))
    joined = numbered.join(laid.drop("__low", "__at"), F.col(target).eqNullSafe(F.col("__class")))
    upto = lambda end, i: F.floor((end - i + (k - 1)) / k)  # noqa: E731 - places below ``end`` that are i modulo k
    fold, filled = F.lit(0), F.lit(0)
    for i in range(k - 1):
        filled = filled + upto(F.col("__end"), i) - upto(F.col("__start"), i)
        fold = fold + (F.col("__number") - F.col("__begin") >= filled).cast("int")
    return joined.withColumn("fold", fold).drop("__number", "__class", "__begin", "__size", "__end", "__start")


def _stratified(df: DataFrame, k: int, target: str, order: str) -> DataFrame:
    known = summaries(df, order, target)
    classes = sorted(known, key=lambda c: known[c].low)
    sizes = dict(zip(classes, stratified_sizes([known[c].count for c in classes], k), strict=True))
    ranks = {c: _starts(sizes[c]) for c in classes}
    found = select_ranks(df, order, ranks, target, known)
    fold = F.lit(None).cast("int")
    for c in classes:
        blocks = _starts_with_skips(sizes[c])
        # Empty blocks share their start with the next one, so each start counts for all of them.
        inner = F.lit(blocks[0])
        for rank, step in blocks[1]:
            inner = inner + (F.col(order) >= F.lit(found[(c, rank)])).cast("int") * step
        fold = F.when(F.col(target).eqNullSafe(F.lit(c)), inner).otherwise(fold)
    return df.withColumn("fold", fold)


def _starts_with_skips(sizes: Sequence[int]) -> tuple[int, list[tuple[int, int]]]:
    """First non-empty fold, then (rank, fold step) for each later non-empty fold."""
    filled = [i for i, s in enumerate(sizes) if s]
    at, out = 0, []
    for previous, current in zip(filled, filled[1:], strict=False):
        at += sizes[previous]
        out.append((at, current - previous))
    return filled[0], out
