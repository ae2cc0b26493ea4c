"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its shingles, each labelled with its occurrence number: of five words for the first sketches, of
three for the others, which still meet where every fifth word differs. A sketch takes the two labelled shingles with the
smallest hashes and keeps them in the order of the text, so that a match speaks for a small edit distance and not only for
common content. Texts that share a sketch are candidates. Two texts are near duplicates if the edit distance of their words
is at most a fifth of the longer one (similarity 0.8 or more).

Texts of up to ``SHORT`` words also meet under each of their three-word windows (two-word ones for texts of four or five
words): of n words with n / 5 edits at least one such window is left unchanged, so short texts leave nothing to chance.

Scale: equal texts are one node from the start, and only texts that share a sketch with another go on. All sketches whose
smallest text is the same make one group, so texts that meet under many sketches are sent and compared once and not for
each. Groups are dealt out in blocks of at most about ``BLOCK`` texts, each with its words, and compared inside a task: a
union-find knows which of them are one class already, from earlier rounds or from this block, so texts of one class are
never compared again and a block gives back the links of a spanning forest, at most one a text. Counts of words by hash, then
the number of shared words, rule out nearly all pairs before an alignment.

Rounds: first the sketches of the ``FIRST`` bands, whose links join most groups; then the sketches of the other bands that
still hold several classes. A group of up to ``BLOCK`` texts is complete with that. Of larger ones that are still apart,
all texts are compared with the one of most links, which joins stars, and then block by block every text outside the
largest class with every text. So every two similar texts with an equal sketch come into one class, and rows stay in
proportion to the texts of the groups; only comparisons inside blocks grow with the texts of a group times those outside
its largest class. Links are closed to classes by rounds of smallest labels.

Defined results: a null text or one without words is a class of its own; texts of fewer than five words are one
shingle; equal texts are one class; a null doc_id is a document like any other and comes last in the choice of the
document that stands for its class; an empty table gives an empty result; extra columns are ignored, or kept by
``keep_one``. Texts are told apart by a 64-bit hash, the words of compared texts by 32 bits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monsoon.llm.common import WORD, broadcast_if_small, text_or_empty
from monsoon.session import cut_lineage

SHINGLE, PICKS, SKETCHES = 5, 2, 48
#: Shorter shingles for all sketches but the first LONGER ones; texts of up to SHORT words meet under all their windows.
SHORTER, LONGER, SHORT = 3, 8, 40
SIMILARITY = 0.8
#: Sketches that are compared first.
FIRST = 4
#: Texts of a block of comparisons, and counters of a text's words.
BLOCK, BINS = 256, 128
#: Texts on each side of a block where large groups are compared in full: larger, as each text is sent once a block.
WIDE = 1024
#: Words from which a cheap upper bound of the distance is tried before the band.
LONG = 20_000
#: Bits of a sketch's number and band in the key that its texts meet under; windows of short texts are a band of their own.
KEY_BITS = 57
#: Node lists of up to so many rows (16 to 28 bytes each) are sent to the tasks; above, both sides are shuffled.
SMALL = 500_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
_SHIFT = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


_SEEDS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _M1)


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word; bytes.split knows just the ASCII blanks."""
    words = (text or "").encode("utf-8", "replace").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def occurrences(values: np.ndarray) -> np.ndarray:
    """How many equal values come before each value."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out = np.empty(len(values), np.uint64)
    out[order] = np.arange(len(values)) - np.repeat(starts, np.diff(np.r_[starts, len(values)]))
    return out


def shingled(hashes: np.ndarray, size: int) -> np.ndarray:
    k = min(size, len(hashes))
    shingles = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        shingles = shingles * _M1 + hashes[i : i + len(shingles)]
    return _mix(shingles)


def order_minhash(hashes: np.ndarray) -> np.ndarray:
    """The sketches of a text with at least one word."""
    return np.concatenate([_picked(shingled(hashes, SHINGLE), _SEEDS[:LONGER]), _picked(shingled(hashes, SHORTER), _SEEDS[LONGER:])])


def _picked(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    labelled = shingles + occurrences(shingles) * _M3
    out = np.empty(len(seeds), np.uint64)
    rows = max(1, min(len(seeds), 2_000_000 // len(labelled)))  # bounds the memory of very long texts
    for begin in range(0, len(seeds), rows):
        x = _mix((labelled[None, :] ^ seeds[begin : begin + rows, None]) * _M1)
        every, first = np.arange(len(x)), x.argmin(axis=1)
        second = first
        if len(labelled) >= PICKS:
            x[every, first] = np.uint64(0xFFFFFFFFFFFFFFFF)
            second = x.argmin(axis=1)
        left, right = np.minimum(first, second), np.maximum(first, second)
        out[begin : begin + rows] = _mix(shingles[left] * _M3 + shingles[right])
    return out


def short_windows(hashes: np.ndarray) -> np.ndarray:
    """All keys of a short text, none of a longer one."""
    if len(hashes) > SHORT:
        return np.zeros(0, np.uint64)
    parts = [shingled(hashes, SHORTER)]
    if len(hashes) in (4, 5):
        parts.append(shingled(hashes, 2))
    return np.unique(np.concatenate(parts))


def word_places(a: list[int]) -> dict[int, int]:
    """For each word a number whose bits are its places."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    return places


def banded_distance(a, b, most: int, places: dict[int, int] | None = None) -> int:
    """Edit distance of two sequences, or ``most + 1`` if it is larger, from the diagonals up to ``most`` off.

    A column of the band is held as the bits of one number, a bit for each row whose distance is one more or one less than
    that of the row above, so a step to the next column is a handful of operations on whole numbers. The band moves down by
    a row with each column; what is followed is its lowest row until that is the last one, then the last row.
    """
    a, b = (x.tolist() if isinstance(x, np.ndarray) else x for x in (a, b))
    rows, columns, far = len(a), len(b), most + 1
    if abs(rows - columns) > most:
        return far
    places = word_places(a) if places is None else places
    width = 2 * most + 1
    every = (1 << width) - 1
    lowest = 1 << (width - 1)
    more, less = every ^ ((1 << most) - 1), 0  # in the first column each row has one more than the one above
    score = min(rows, most)
    for j, word in enumerate(b, 1):
        same, off = places.get(word, 0), j - most - 1
        same = (same >> off if off >= 0 else same << -off) & every
        level = (((same & more) + more) ^ more) | same | less  # equal to the cell up left
        right_more = (less | ~(level | more)) & every
        right_less = level & more
        if j + most <= rows:
            score += not level & lowest
        else:
            row = rows - j + most
            score += (right_more >> row & 1) - (right_less >> row & 1)
        # Each column that is left can take off one at most, once the last row is reached.
        if score > most + columns - max(j, rows - most):
            return far
        down = (level & every) >> 1
        more, less = (right_less | ~(down | right_more)) & every, down & right_more
    return min(far, score)


def _anchored(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """An upper bound of the distance: words in the same order on both sides stay, what lies between is replaced."""
    ka, kb = a + occurrences(a) * _M3, b + occurrences(b) * _M3
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    inside = np.abs(ia - ib) <= most
    order = np.argsort(ia[inside])
    ia, ib = ia[inside][order], ib[inside][order]
    if not len(ia):
        return max(len(a), len(b))
    chain = _increasing(ib)
    ia, ib = np.r_[-1, ia[chain], len(a)], np.r_[-1, ib[chain], len(b)]
    return int(np.maximum(np.diff(ia) - 1, np.diff(ib) - 1).sum())


def _increasing(values: np.ndarray) -> np.ndarray:
    """Positions of a longest increasing subsequence."""
    from bisect import bisect_left

    tails: list[int] = []
    ends: list[int] = []
    before = np.full(len(values), -1)
    for i, v in enumerate(values.tolist()):
        at = bisect_left(tails, v)
        before[i] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[at], ends[at] = v, i
    out, i = [], ends[-1]
    while i >= 0:
        out.append(i)
        i = int(before[i])
    return np.array(out[::-1])


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether 1 - distance / length of the longer one is at least ``least``."""
    most = allowed(max(len(a), len(b)), least)
    if abs(len(a) - len(b)) > most:
        return False
    shared = len(np.intersect1d(a + occurrences(a) * _M3, b + occurrences(b) * _M3, assume_unique=True))
    return bool(max(len(a), len(b)) - shared <= most and aligned(a.tolist(), b.tolist(), int(most)))


def allowed(longest, least: float):
    """Edits of similar texts, as whole numbers."""
    return np.int64((1.0 - least) * longest + 1e-9)


def aligned(a: list[int], b: list[int], most: int, places: dict[int, int] | None = None) -> bool:
    if max(len(a), len(b)) > LONG and _anchored(np.array(a, np.uint64), np.array(b, np.uint64), most) <= most:
        return True
    return banded_distance(a, b, most, places) <= most


def meeting_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys a text with words meets others under: one a sketch, and all windows of a short text."""
    sketches, windows = order_minhash(hashes), short_windows(hashes)
    bands = np.r_[np.arange(SKETCHES, dtype=np.uint64), np.full(len(windows), SKETCHES, np.uint64)]
    keys = (bands << np.uint64(KEY_BITS)) | (np.r_[sketches, windows] >> np.uint64(64 - KEY_BITS))
    return keys.view(np.int64)


MADE = "doc_id bigint, node bigint, n bigint, keys array<bigint>, words binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, keys, words = [], [], []
        for text in b.column("text").to_pylist():
            hashes = word_hashes(text)
            sizes.append(len(hashes))
            keys.append(meeting_keys(hashes) if len(hashes) else [])
            words.append((hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
        columns = [pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), *columns], names=["doc_id", "node", "n", "keys", "words"])


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, node, n (words), keys and words (their hashes) of every row, numbered by ``row``: a written table."""
    made = _text_rows(docs).select("doc_id", "node", "text").mapInArrow(_sketch, MADE)
    return cut_lineage(made.withColumn("row", F.monotonically_increasing_id()))


def _one_a_text(made: DataFrame) -> DataFrame:
    """The rows with words, one of each text."""
    copied = made.filter("n > 0").groupBy("node").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    copied = cut_lineage(copied.filter("rows > 1").select("node", "first"))
    marked = made.filter("n > 0").join(broadcast_if_small(copied, copied.count(), SMALL), "node", "left")
    return marked.filter("first IS NULL OR row = first").drop("first")


def _crowds(texts: DataFrame, bands: Column, turn: int) -> DataFrame:
    """Groups of texts with a common key of ``bands`` and of several classes: key (of this turn), node, root and size.

    Texts (node, root, keys) that meet under many keys shall not be sent once for each: all keys with the same smallest node
    become one group under that node, so every two texts of one key are in one group.
    """
    laid = texts.select("node", "root", F.explode("keys").alias("key")).filter(bands)
    many = laid.groupBy("key").agg(
        F.count("*").alias("size"), F.bit_xor("node").alias("all"), F.min("node").alias("low"),
        F.min("root").alias("least"), F.max("root").alias("most"),
    )
    # Of keys with the same texts one is enough.
    many = many.filter("size > 1 AND least <> most").groupBy("size", "all", "low").agg(F.min("key").alias("key"))
    many = cut_lineage(many.select("key", "low"))
    rows = laid.join(broadcast_if_small(many, many.count(), SMALL), "key")
    rows = cut_lineage(rows.groupBy(F.xxhash64("low", F.lit(turn)).alias("key"), "node").agg(F.min("root").alias("root")))
    sizes = cut_lineage(rows.groupBy("key").agg(F.count("*").alias("size")))
    return cut_lineage(rows.join(broadcast_if_small(sizes, sizes.count(), SMALL), "key"))


class _Classes:
    """Union-find over the rows of a block: ``of`` has each row's class."""

    def __init__(self, roots: np.ndarray):
        self.of = np.unique(roots, return_inverse=True)[1]

    def join(self, x: int, y: int) -> None:
        self.of[self.of == self.of[y]] = self.of[x]


def block_links(node: np.ndarray, root: np.ndarray, side: np.ndarray, words: list[bytes], least: float) -> list[tuple[int, int, int]]:
    """Links of similar rows of a block that join two classes: rows of side 2 among each other, of side 1 with side 0.

    With each link goes the smallest node of its class in this block.
    """
    texts = [np.frombuffer(w, np.uint32) for w in words]
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    # Capped counts differ less than the real ones, so nothing similar is ruled out.
    bags = np.array([np.minimum(np.bincount(t % BINS, minlength=BINS), 255) for t in texts], np.int16).reshape(-1, BINS)

    @functools.cache
    def marks(i: int) -> np.ndarray:
        own = texts[i].astype(np.uint64)
        return (own << _SHIFT) | occurrences(own)

    def similar_rows(x: int, i: int, size: int, edits: int) -> bool:
        shared = len(np.intersect1d(marks(x), marks(i), assume_unique=True))
        if size - shared > edits:
            return False
        if x not in places:
            places.clear()
            places[x] = word_places(texts[x].tolist())
        return aligned(texts[x].tolist(), texts[i].tolist(), edits, places[x])

    places: dict[int, dict[int, int]] = {}
    classes, links = _Classes(root), []
    others = np.flatnonzero(side == 0)
    for x in np.flatnonzero(side > 0).tolist():
        y = others if side[x] == 1 else np.arange(x)
        y = y[classes.of[y] != classes.of[x]]
        longest = np.maximum(n[y], n[x])
        most = allowed(longest, least)
        # An edit moves the sum of differences and the lengths by two at most.
        far = np.abs(bags[y] - bags[x]).sum(axis=1) + np.abs(n[y] - n[x])
        near = far <= 2 * most
        y, longest, most = (v[near][np.argsort(far[near], kind="stable")].tolist() for v in (y, longest, most))
        for i, size, edits in zip(y, longest, most):
            if classes.of[i] != classes.of[x] and similar_rows(x, i, size, edits):
                links.append((x, i))
                classes.join(x, i)
    smallest = {c: int(node[classes.of == c].min()) for c in {int(classes.of[x]) for x, _ in links}}
    return [(int(node[x]), int(node[i]), smallest[int(classes.of[x])]) for x, i in links]


def _blocks(least: float):
    """Runs ``block_links`` over the sorted rows of each gid."""

    def compare(rows: pa.Table) -> pa.RecordBatch:
        node, root, side = (rows.column(c).to_numpy() for c in ("node", "root", "side"))
        links = block_links(node, root, side, rows.column("words").to_pylist(), least)
        columns = np.array(links, np.int64).reshape(-1, 3).T
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for b in batches:
            gid = b.column("gid").to_numpy()
            edges = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1], True]) if len(gid) else np.zeros(0, int)
            for begin, end in zip(edges[:-1], edges[1:]):
                if held and gid[begin] != current:
                    yield compare(pa.Table.from_batches(held))
                    held = []
                current = gid[begin]
                held.append(b.slice(begin, end - begin))
        if held:
            yield compare(pa.Table.from_batches(held))

    return run


def _linked(dealt: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b, low) of the blocks of ``dealt`` (gid, node, root, side)."""
    dealt = cut_lineage(dealt)
    # Rows of four numbers; where they are few, words are only shuffled to their blocks.
    rows = texts.join(broadcast_if_small(dealt, dealt.count(), SMALL), "node").select("gid", "node", "root", "side", "words")
    rows = rows.repartition("gid").sortWithinPartitions("gid")
    return cut_lineage(rows.mapInArrow(_blocks(least), "a bigint, b bigint, low bigint"))


def _parts(size: Column, block: int = BLOCK) -> Column:
    return F.ceil(size / block).cast("int")


def _place(parts: Column) -> Column:
    return F.pmod(F.xxhash64("node"), parts).cast("int")


def _inside(rows: DataFrame) -> DataFrame:
    """Blocks of the texts of each key (key, node, size, root)."""
    gid = F.xxhash64("key", _place(_parts(F.col("size"))))
    return rows.select(gid.alias("gid"), "node", "root", F.lit(2).alias("side"))


def _rooted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    few = broadcast_if_small(labels, labels.count(), SMALL)
    return rows.join(few, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _apart(rows: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (key, node, size, root) of keys whose texts are still of several classes.

    With each row goes what the blocks below need to know of its key, so the rows are joined by key once: pivot, the text of
    most links, and top, its class; major, the largest class, and minors, the number of texts outside of it.
    """
    ends = links.select(F.col("a").alias("node")).union(links.select("b"))
    own = cut_lineage(_rooted(rows.drop("root"), labels))
    ranked = own.join(ends.groupBy("node").agg(F.count("*").alias("degree")), "node", "left")
    per = ranked.groupBy("key", "root").agg(
        F.count("*").alias("rows"), F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "node")).alias("best")
    )
    live = per.groupBy("key").agg(
        F.count("*").alias("classes"), F.sum("rows").alias("rows"), F.max(F.struct("rows", "root")).alias("first"),
        F.max(F.struct("best.degree", "best.node", "root")).alias("p"),
    ).filter("classes > 1")
    live = cut_lineage(live.select(
        "key", F.col("p.node").alias("pivot"), F.col("p.root").alias("top"), F.col("first.root").alias("major"),
        (F.col("rows") - F.col("first.rows")).alias("minors"),
    ))
    return cut_lineage(own.join(broadcast_if_small(live, live.count(), SMALL), "key"))


def _with_pivots(live: DataFrame) -> DataFrame:
    """Blocks of each text of a key with the text of the key that has most links, where they are of two classes."""
    # As one row a text has no classes to tell apart but the pivot's, the pivot is the left side of each block.
    gid = F.xxhash64("key", _place(_parts(F.col("size"))))
    met = live.filter("root <> top").select(gid.alias("gid"), "node", "root", F.lit(0).alias("side"))
    each = live.filter("node = pivot").select("key", "node", "root", F.explode(F.sequence(F.lit(0), _parts(F.col("size")) - 1)).alias("i"))
    return met.unionByName(each.select(F.xxhash64("key", "i").alias("gid"), "node", "root", F.lit(1).alias("side")))


def _across(live: DataFrame) -> DataFrame:
    """Blocks of each text outside the largest class of a key with all texts of the key."""
    parts, few = _parts(F.col("size"), WIDE), _parts(F.col("minors"), WIDE)
    every = live.select("key", "node", "root", F.lit(0).alias("side"), _place(parts).alias("j"), F.explode(F.sequence(F.lit(0), few - 1)).alias("i"))
    minor = live.filter("root <> major").select(
        "key", "node", "root", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("j"), _place(few).alias("i")
    )
    return every.unionByName(minor).select(F.xxhash64("key", "i", "j").alias("gid"), "node", "root", "side")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges: the smallest node that it is connected with.

    Each round every node takes the smallest label around it and then the label of that label; the number of rounds
    grows with the logarithm of the longest path.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
    labels = cut_lineage(labels)
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
        own = labels.select("node", "root", F.col("root").alias("old"))
        near = own.unionByName(around, allowMissingColumns=True).groupBy("node").agg(F.min("root").alias("via"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        # The label's own label; a label is a node of the same class, so it is always found.
        new = cut_lineage(near.join(jump, "via").select("node", F.least("via", "far").alias("root"), "old"))
        labels = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) after further links (a, b) of nodes; nodes without a label are their own root."""
    between = links.select("a", "b")
    for c in ("a", "b"):
        own = labels.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        between = between.join(own, c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    between = between.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).filter("a <> b").distinct()
    tops = components(between)
    moved = labels.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    moved = moved.select("node", F.coalesce("top", "root").alias("root"))
    return cut_lineage(moved.unionByName(tops.join(labels.select("node"), "node", "left_anti").select("node", "root")))


def _text_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and node; the node is null for texts without a word."""
    text = text_or_empty(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_node(F.col("text")).alias("node"))


def text_node(text: Column) -> Column:
    text = text_or_empty(text)
    return F.when(text.rlike(WORD), F.xxhash64(text))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, node and root of every row of ``docs``: rows with equal roots are near duplicates of each other."""
    made = sketched(docs)
    one = _one_a_text(made)
    early = F.col("key") < (FIRST << KEY_BITS)
    crowd = _crowds(one.select("node", F.col("node").alias("root"), "keys"), early, 1)
    links = _linked(_inside(crowd), one.select("node", "words"), least)
    # Both ends hang on the smallest node of their block, which makes short ways.
    stars = links.select("a", F.col("low").alias("b")).union(links.select("b", "low")).filter("a <> b")
    labels = components(stars)
    late = _crowds(_rooted(one.select("node", "keys"), labels), ~early, 2)
    more = _linked(_inside(late), one.select("node", "words"), least)
    labels, links = _merged(labels, more), links.unionByName(more)
    live = _apart(crowd.unionByName(late).filter(F.col("size") > BLOCK), labels, links)
    if not live.isEmpty():
        joined = _linked(_with_pivots(live), one.select("node", "words"), least)
        if not joined.isEmpty():
            labels = _merged(labels, joined)
            live = _apart(live.select("key", "node", "size", "root"), labels, links)
    if not live.isEmpty():
        labels = _merged(labels, _linked(_across(live), one.select("node", "words"), least))
    found = made.select("doc_id", "node").join(labels, "node", "left")
    return found.select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and class_size of every row of ``docs``."""
    found = cut_lineage(classes(docs, least))
    sizes = found.filter(F.col("root").isNotNull()).groupBy("root")
    # Written, so that both sides of the join below are plain exchanges, of which Spark splits the hot ones.
    sizes = cut_lineage(sizes.agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    alone = found.filter(F.col("root").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.join(sizes, "root").select("doc_id", "class_id", "class_size").unionByName(alone)


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest doc_id stays."""
    found = cut_lineage(classes(docs, least).filter(F.col("node").isNotNull()))
    # Equal ids come together with a count, so that two texts under one id don't both stay.
    rows = found.groupBy("root", "doc_id", "node").agg(F.count("*").alias("copies"))
    first = found.groupBy("root").agg(F.min("doc_id").alias("first_id"))
    ranked = rows.join(first, "root").withColumn("is_first", F.col("doc_id").eqNullSafe(F.col("first_id")))
    chosen = ranked.filter("is_first").groupBy("root").agg(F.min("node").alias("first_node"))
    ranked = ranked.join(chosen, "root").withColumn("stays", F.expr("is_first and node = first_node"))
    odd = cut_lineage(ranked.filter("not stays or copies > 1").select(
        F.col("doc_id").alias("_odd_id"), F.col("node").alias("_odd_node"), "stays"
    ))
    names = _free(docs, "_node", "_stays")
    node, stays = (F.col(c) for c in names)
    marked = docs.withColumn(names[0], text_node(F.col("text"))).alias("d")
    few = broadcast_if_small(odd.withColumnRenamed("stays", names[1]), odd.count(), SMALL)
    match = (node == F.col("_odd_node")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("_odd_id"))
    marked = marked.join(few, match, "left").select("d.*", names[1])
    plain = marked.filter(stays.isNull()).drop(*names)
    # Rows equal in id and text: one of them stays.
    repeated = marked.filter(stays).dropDuplicates(["doc_id", names[0]]).drop(*names)
    return plain.unionByName(repeated)


def _free(docs: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out
