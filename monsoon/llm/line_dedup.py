"""Line deduplication by pairwise alignment.

A document is the sequence of the hashes of its lines, without blanks around them. Every line found in two documents
or more has an owner, the first document with it, and a later document is paired with the owners of its shared lines:
documents are found through the lines that they share, and a line in many documents makes one pair for each of them,
not all pairs. Each pair is aligned by patience diff over its shared lines: lines that both have once anchor the alignment
(the longest increasing sequence of them), gaps between anchors are aligned in the same way, at last by occurrence. Runs
of aligned lines that follow each other in both documents are blocks; blocks of ``MIN_WORDS`` words or more are deleted
from the later document. The first document with a line never loses it, so every deleted line stays somewhere.

``rarest`` lowers the work where many lines are shared: of the lines of a document with the same owner the rarest one
stands for the pair, so a pair is made once.

Scale: only hashes, positions and word counts are shuffled, 20 bytes a line, and only lines that are shared at all
reach the alignment. Line owners come from two numeric aggregations with partial sums on the map side. Joins on a hot
line or a hot owner are equi-joins that adaptive execution splits.

Defined results: null and empty texts have no lines and are left alone; documents are ordered by doc_id, nulls last, then
by a hash of the text; rows equal in id and text are one document and get the same result; blank lines are never
deleted on their own account; an empty table gives an empty result; extra columns are ignored, or kept by
``drop_lines``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monsoon.llm.common import BLANKS, SPACE, broadcast_if_small, let, row_key, text_or_empty
from monsoon.session import cut_lineage

MIN_WORDS = 5
SMALL = 500_000
#: The order of a null id.
LAST = 2**63 - 1


def _documents(docs: DataFrame) -> DataFrame:
    """id (never null), key, and the lines (h, n words) of every row; blank lines have the hash null."""
    text = text_or_empty(F.col("text"))
    line = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS)))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id").cast("long"), F.col("text")).alias("key"),
        line.alias("line"),
    )
    made = F.transform(
        F.col("line"),
        lambda x: F.struct(
            F.when(F.length(x) > 0, F.xxhash64(x)).alias("h"),
            F.when(F.length(x) > 0, F.size(F.split(x, SPACE))).otherwise(0).alias("n"),
        ),
    )
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), "key", made.alias("lines"))


def owners(lines: DataFrame) -> DataFrame:
    """Of lines (id, key, h): the lines in two documents or more, their first document and their number of documents."""
    # Ids first, keys second: both aggregations are numeric, so they hash and sum on the map side.
    by_id = lines.groupBy("h", "id").agg(F.min("key").alias("key"), F.count_distinct("key").alias("documents"))
    by_line = by_id.groupBy("h").agg(
        F.min("id").alias("owner_id"), F.min_by("key", "id").alias("owner_key"), F.sum("documents").alias("documents")
    )
    return by_line.filter("documents > 1")


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence of different values."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        before[i] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[at], ends[at] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of values that are alone on both sides, in increasing order on both."""
    ca, cb = Counter(a), Counter(b)
    at = {v: i for i, v in enumerate(b) if cb[v] == 1}
    both = [(i, at[v]) for i, v in enumerate(a) if ca[v] == 1 and v in at]
    return [both[i] for i in _increasing([j for _, j in both])]


def _by_occurrence(values: list) -> list[tuple]:
    seen: Counter = Counter()
    out = []
    for v in values:
        out.append((v, seen[v]))
        seen[v] += 1
    return out


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of positions of equal values, increasing on both sides: patience diff without recursion."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            found.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            found.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        anchors = _anchors(a[i0:i1], b[j0:j1])
        if not anchors:  # only repeated lines: their occurrences are the anchors, and nothing is left between them
            found += [(i0 + i, j0 + j) for i, j in _anchors(_by_occurrence(a[i0:i1]), _by_occurrence(b[j0:j1]))]
            continue
        last = (i0, j0)
        for i, j in anchors:
            found.append((i0 + i, j0 + j))
            todo.append((last[0], i0 + i, last[1], j0 + j))
            last = (i0 + i + 1, j0 + j + 1)
        todo.append((last[0], i1, last[1], j1))
    return sorted(found)


def common_blocks(a: list[tuple[int, int, int]], b: list[tuple[int, int, int]]) -> list[list[int]]:
    """Places in ``a`` of blocks that ``b`` has too; lines are (number, hash, words).

    Lines that the alignment leaves out, since their block was moved or comes again, are matched one after the other to
    lines of ``b``, each to the line after the one before where that is equal.
    """
    ha, hb = [x[1] for x in a], [x[1] for x in b]
    aligned = patience(ha, hb)
    taken = {i for i, _ in aligned}
    where = {v: j for j, v in reversed(list(enumerate(hb)))}
    moved: list[tuple[int, int]] = []
    for i, v in enumerate(ha):
        if i not in taken and v in where:
            follows = moved and moved[-1][0] == i - 1 and moved[-1][1] + 1 < len(hb) and hb[moved[-1][1] + 1] == v
            moved.append((i, moved[-1][1] + 1 if follows else where[v]))
    blocks: list[list[int]] = []
    for pairs in (aligned, moved):
        before = None
        for i, j in pairs:
            here = (a[i][0], b[j][0])
            if before and here == (before[0] + 1, before[1] + 1):
                blocks[-1].append(i)
            else:
                blocks.append([i])
            before = here
    return blocks


def _align(least: int):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, places = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("id", "key", "at", "h", "n", "o_at", "o_h"))
            for id_, key, at, h, n, o_at, o_h in zip(*columns):
                a = list(zip(at, h, n))
                for block in common_blocks(a, [(x, y, 0) for x, y in zip(o_at, o_h)]):
                    if sum(a[i][2] for i in block) >= least:
                        ids += [id_] * len(block)
                        keys += [key] * len(block)
                        places += [a[i][0] for i in block]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int32())], names=["id", "key", "line"]
            )

    return align


def duplicate_lines(docs: DataFrame, least: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, id, key, n_lines, words), and their lines to delete (id, key, lines, partners)."""
    made = cut_lineage(_documents(docs).dropDuplicates(["id", "key"]))
    every = made.select("id", "key", F.posexplode_outer("lines").alias("at", "s")).select("id", "key", "at", "s.h", "s.n")
    every = every.filter("h is not null")
    owned = cut_lineage(owners(every.select("id", "key", "h")))
    shared = every.join(broadcast_if_small(owned, owned.count(), SMALL), "h")
    shared = cut_lineage(shared)
    # Only shared lines can be aligned; a document's lines come together in its row, in their order.
    rows = shared.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("at", "h", "n"))).alias("own"))
    rows = cut_lineage(rows)
    # One pair for each document and owner, found through the rarest line that they share.
    pairs = (
        shared.filter("id <> owner_id or key <> owner_key")
        .groupBy("id", "key", "owner_id", "owner_key")
        .agg(F.min("documents").alias("rarest"))
    )
    theirs = rows.select(F.col("id").alias("owner_id"), F.col("key").alias("owner_key"), F.col("own").alias("other"))
    pairs = pairs.join(rows, ["id", "key"]).join(theirs, ["owner_id", "owner_key"])
    pairs = pairs.select(
        "id", "key", F.col("own.at").alias("at"), F.col("own.h").alias("h"), F.col("own.n").alias("n"),
        F.col("other.at").alias("o_at"), F.col("other.h").alias("o_h"),
    )
    found = pairs.mapInArrow(_align(least), "id bigint, key bigint, line int")
    # Bounded by the lines of the document, however many partners it has.
    lines = cut_lineage(found.groupBy("id", "key").agg(F.sort_array(F.collect_set("line")).alias("lines")))
    return made, lines


def _held(lines: DataFrame) -> int:
    """Numbers in a table of line lists: what bounds its size."""
    return lines.agg(F.sum(F.size("lines") + 3)).first()[0] or 0


def line_report(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, n_lines, n_deleted, deleted_words, and ``deleted``, the line numbers from 0."""
    made, lines = duplicate_lines(docs, least)
    few = broadcast_if_small(lines.withColumnRenamed("lines", "gone"), _held(lines), SMALL)
    own = made.join(few, ["id", "key"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    # The joined list is short; positions are looked up in the row.
    add = lambda all_: F.aggregate("gone", F.lit(0).cast("long"), lambda acc, i: acc + F.get(all_, i)["n"])
    words = let(F.col("lines"), add)
    filled = F.size(F.filter("lines", lambda x: x["h"].isNotNull())).cast("long")
    return own.select(
        "doc_id", filled.alias("n_lines"), F.size("gone").cast("long").alias("n_deleted"), words.alias("deleted_words"),
        F.array_join("gone", ",").alias("deleted"),
    )


def drop_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the duplicate lines; documents that lose every word are dropped. All columns stay."""
    made, lines = duplicate_lines(docs, least)
    filled = made.select("id", "key", F.size(F.filter("lines", lambda x: x["h"].isNotNull())).alias("filled"))
    gone = lines.join(filled, ["id", "key"]).select(
        F.col("id").alias("_gone_id"), F.col("key").alias("_gone_key"), F.col("lines").alias("_gone"),
        (F.size("lines") == F.col("filled")).alias("_empty"),
    )
    gone = cut_lineage(gone)
    text, doc_id = F.col("d.text"), F.col("d.doc_id").cast("long")
    match = (F.coalesce(doc_id, F.lit(LAST)) == F.col("_gone_id")) & (row_key(doc_id, text) == F.col("_gone_key"))
    # No hint: the lists grow with the corpus, and one plan at every size is easier to foresee than two.
    joined = docs.alias("d").join(gone, match, "left")
    joined = joined.filter(~F.coalesce("_empty", F.lit(False)))
    own = [F.col(f"d.`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    at = docs.columns.index("text")
    cut = joined.select(*own, "_gone", F.when(F.col("_gone").isNotNull(), F.split(text, "\n")).alias("_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    left = F.array_join(let(F.col("_lines"), lambda own: F.transform(kept, lambda i: F.get(own, i))), "\n")
    new = F.when(F.col("_gone").isNull(), F.col(f"_c{at}")).otherwise(left)
    return cut.select(*[(new if i == at else F.col(f"_c{i}")).alias(c) for i, c in enumerate(docs.columns)])
