"""Prefix trie of whole conversations, by collapsing equal sequences.

Identical conversations become one weighted sequence with the list of its conversations. A sequence that is a proper
prefix of another is dropped from the leaves by an anti-join. Each sequence that is left, once and not once per
conversation, is opened into its prefixes, whose weights are added up to the nodes of the trie.

A node is known by two 64-bit numbers: the exclusive or of the hashes of its turns, each hashed with its depth. So prefixes
are running exclusive ors, a parent is found by taking the last turn out again, and no task needs a whole conversation.

Sums over subtrees need no walk either. A subtree holds the prefixes, from the node on, of all sequences through the node;
a node counts for the sequence of its smallest member. The nodes that count for one sequence are the end of its path, so
both the members' characters and the nodes' own ones are differences of running sums that a sequence brings along.

Scale: turns are dealt out by range and numbered by a count per partition and conversation, running sums go by blocks of
``BLOCK`` turns, lists of ends are sorted by range and hashed piece by piece, so neither a conversation nor a list with
most of all rows lands in one task's memory. All groupings are partial sums first.

Defined results: null roles and texts are empty; turns are in the order of turn (null first), then role, then text;
repeated rows are turns of their own; rows without a conv_id are left out; no conversations, no nodes (not even the root);
extra columns are ignored; very long texts are only hashed and measured.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monsoon.llm.common import text_or_empty
from monsoon.session import cut_lineage

#: Turns of one conversation that a window sums up at once, and conversations in one piece of a list of ends.
BLOCK, PIECE = 4096, 4096
#: The longest shared beginning is one turn less, and conversations share the beginning of the last full hundred.
SHARES, FAMILY = 6, 100

KEY = ["x1", "x2"]
PARENT = ["p1", "p2"]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted turns of each conversation within this partition."""
    part = TaskContext.get().partitionId()
    last, seen = None, 0
    for b in batches:
        conv = b.column("conv_id").to_numpy()
        if not len(conv):
            continue
        starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        sizes = np.diff(np.r_[starts, len(conv)])
        at = np.arange(len(conv)) - np.repeat(starts, sizes)
        before = seen if conv[0] == last else 0
        at[: sizes[0]] += before
        last, seen = conv[-1], int(sizes[-1]) + (before if len(sizes) == 1 else 0)
        parts = pa.array(np.full(len(conv), part, np.int64))
        yield pa.RecordBatch.from_arrays([*b.columns, parts, pa.array(at)], names=["conv_id", "role", "text", "part", "at"])


def positions(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role and text of every turn."""
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text_or_empty(F.col("role")).alias("role"), text_or_empty(F.col("text")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    order = ["conv_id", "turn", "role", "text"]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    local = cut_lineage(dealt.mapInArrow(_number, "conv_id bigint, role string, text string, part bigint, at bigint"))
    counts = local.groupBy("conv_id", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first conversation of a partition can have begun in an earlier one.
    begun = counts.withColumn("before", F.sum("rows").over(before)).filter("before IS NOT NULL").drop("rows")
    placed = local.join(cut_lineage(begun), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.coalesce("before", F.lit(0)) + F.col("at")).alias("position"), "role", "text")


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the turns of their family's first one.

    Gives the turns (conv_id, depth from 1, role, text) and all conversations (conv_id, length), turnless ones too. The
    first h turns, h = crc32 of the id modulo ``SHARES``, come from conversation id - id % ``FAMILY``.
    """
    own = cut_lineage(positions(conversations))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARES
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    sizes = cut_lineage(own.groupBy("conv_id").agg(F.count("*").alias("n")))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = sizes.withColumns({"base": family, "h": shared}).join(bases, "base", "left")
    heads = heads.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    heads = cut_lineage(
        heads.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    )
    # A family is at most 199 conversations (around 0) and its head five turns.
    lent = own.filter((F.col("conv_id") % FAMILY == 0) & (F.col("position") < SHARES - 1)).withColumnRenamed("conv_id", "base")
    first = heads.join(lent, "base").filter("position < h").select("conv_id", (F.col("position") + 1).alias("depth"), "role", "text")
    kept = own.join(heads, "conv_id").filter("position >= h")
    kept = kept.select("conv_id", (F.expr("position - h + taken") + 1).alias("depth"), "role", "text")
    return first.unionByName(kept), heads.select("conv_id", "length")


def _running(turns: DataFrame) -> DataFrame:
    """Adds the node of each turn's prefix and the characters up to it to (conv_id, depth, y1, y2, chars)."""
    blocked = cut_lineage(turns.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK)))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"x1": F.bit_xor("y1"), "x2": F.bit_xor("y2"), "upto": F.sum("chars")}
    run = blocked.withColumns({c: f.over(inside) for c, f in sums.items()})
    # Blocks before: only conversations of more than one block have any.
    totals = blocked.groupBy("conv_id", "block").agg(*[f.alias(f"b_{c}") for c, f in sums.items()])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = {"b_x1": F.bit_xor("b_x1"), "b_x2": F.bit_xor("b_x2"), "b_upto": F.sum("b_upto")}
    before = totals.withColumns({c: f.over(earlier) for c, f in carried.items()}).filter("b_upto IS NOT NULL")
    joined = run.join(cut_lineage(before), ["conv_id", "block"], "left")
    none = F.lit(0).cast("long")
    x1, x2 = (F.col(c).bitwiseXOR(F.coalesce(f"b_{c}", none)) for c in KEY)
    return joined.select(
        "conv_id", "depth", "chars", (F.col("upto") + F.coalesce("b_upto", none)).alias("upto"),
        x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("y1")).alias("p1"), x2.bitwiseXOR(F.col("y2")).alias("p2"),
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of up to PIECE conversations that end at one node, from rows sorted by node and conversation."""
    names = ["x1", "x2", "first", "rows", "length", "chars", "ids"]
    kinds = [*[pa.int64()] * 6, pa.string()]
    held: list | None = None  # x1, x2, length, chars and the ids
    out: list[tuple] = []

    def close() -> None:
        if held:
            out.append((held[0], held[1], held[4][0], len(held[4]), held[2], held[3], ",".join(map(str, held[4]))))

    for b in batches:
        for x1, x2, conv, length, chars in zip(*(b.column(c).to_pylist() for c in ("x1", "x2", "conv_id", "length", "chars"))):
            if held is None or (x1, x2) != (held[0], held[1]) or len(held[4]) == PIECE:
                close()
                held = [x1, x2, length, chars, []]
            held[4].append(conv)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        out = []
    close()
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node from its pieces in order; only the running digest is held."""
    key, running = None, None
    done: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array([r[0][0] for r in done], pa.int64()), pa.array([r[0][1] for r in done], pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in done], pa.string())], names=["x1", "x2", "ends_sha256"])

    for b in batches:
        for x1, x2, ids in zip(*(b.column(c).to_pylist() for c in ("x1", "x2", "ids"))):
            if (x1, x2) != key:
                if running:
                    done.append((key, running.hexdigest()))
                key, running = (x1, x2), hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        yield batch()
        done = []
    if running:
        done.append((key, running.hexdigest()))
    yield batch()


def collapse(conversations: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted sequences (x1, x2, conv_id: smallest, weight, length, chars) and their lists of ends, in pieces."""
    last = prefixes.select("conv_id", "depth", *KEY, "upto")
    ends = conversations.join(last, (conversations.conv_id == last.conv_id) & (F.col("depth") == F.col("length")), "left")
    zero = F.lit(0).cast("long")
    ends = ends.select(conversations.conv_id, "length", *[F.coalesce(c, zero).alias(c) for c in KEY], F.coalesce("upto", zero).alias("chars"))
    order = [*KEY, "conv_id"]
    dealt = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = "x1 bigint, x2 bigint, first bigint, rows bigint, length bigint, chars bigint, ids string"
    pieces = cut_lineage(dealt.mapInArrow(_pieces, pieces))
    sequences = pieces.groupBy(*KEY).agg(
        F.min("first").alias("conv_id"), F.sum("rows").alias("weight"), F.max("length").alias("length"), F.max("chars").alias("total")
    )
    return cut_lineage(sequences), pieces


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes over sequences of turns (conv_id, depth from 1, role, text) of ``conversations`` (conv_id, length).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. The
    last turn of a node is turn ``depth`` of conversation ``conv_id``: ``with_turns`` adds it.
    """
    hashed = turns.select(
        "conv_id", "depth", F.length("text").cast("long").alias("chars"),
        F.xxhash64("depth", "role", "text").alias("y1"), F.xxhash64("text", "role", F.lit(1), "depth").alias("y2"),
    )
    prefixes = cut_lineage(_running(hashed))
    sequences, pieces = collapse(conversations, prefixes)
    of = sequences.select("conv_id", "weight", "total", F.col("x1").alias("end1"), F.col("x2").alias("end2"))
    opened = cut_lineage(prefixes.join(of, "conv_id"))
    # A sequence whose end is the parent of some prefix is a proper prefix itself.
    longer = opened.select(F.col("p1").alias("x1"), F.col("p2").alias("x2")).distinct()
    leaves = sequences.join(longer, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    zero = F.lit(0).cast("long")
    root = of.select("conv_id", zero.alias("depth"), zero.alias("chars"), zero.alias("upto"), *[zero.alias(c) for c in (*KEY, *PARENT)], "weight", "total")
    paths = cut_lineage(opened.drop("end1", "end2").unionByName(root).join(leaves, "conv_id", "left"))
    before = F.col("upto") - F.col("chars")
    nodes = cut_lineage(
        paths.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("weight").alias("n_convs"),
            F.count("leaf").alias("n_leaves"), F.sum(F.col("weight") * (F.col("total") - before)).alias("with_members"),
            F.max(before).alias("before"), *[F.max(c).alias(c) for c in PARENT],
        )
    )
    # The nodes that count for a sequence are the end of its path: its first one decides.
    tops = cut_lineage(nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.min("before").alias("top_before")))
    own = paths.join(tops, "conv_id").select(*KEY, (F.col("total") - F.greatest(before, F.col("top_before"))).alias("once"))
    once = own.groupBy(*KEY).agg(F.sum("once").alias("once"))
    placed = nodes.join(tops.drop("top_before"), "conv_id")
    heads = placed.filter("depth = top AND depth > 0").select(*[F.col(c).alias(f"h{c}") for c in KEY], *PARENT)
    parents = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("above"))
    heads = cut_lineage(heads.join(parents, PARENT).select(F.col("hx1").alias("x1"), F.col("hx2").alias("x2"), "above"))
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    ends = pieces.select(*KEY, "first", "ids").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    ends = ends.mapInArrow(_digest, "x1 bigint, x2 bigint, ends_sha256 string")
    found = placed.join(once, KEY, "left").join(heads, KEY, "left").join(children, KEY, "left").join(ends, KEY, "left")
    parent = F.when(F.col("depth") > 0, F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("above")))
    return found.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        (F.col("with_members") - F.coalesce("once", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes with the role and text of their last turn; the root has none."""
    return nodes.join(turns, ["conv_id", "depth"], "left")
