"""Spelling variants by search schemes over FM-indexes in both directions.

Two words are near if one inserted, deleted or replaced code point makes one the other. Then one half of a word stands
unchanged at the same end of the other word. The search scheme has two searches: the first half exactly from the word's
beginning, then one error on the way to its end; and the second half exactly from the word's end, then one error on the way
to its beginning. A search runs in an FM-index of the delimited vocabulary: the words that a piece stands in are an interval
of suffix ranks, and a step to the next code point narrows it by two rank queries. As words are delimited, a half is
anchored at its delimiter and each search grows to one side only, the first to the right, the second to the left; each has
the index of its direction (that of the reversed text steps to the right). Branches are tried only where an interval holds
more than one word and a code point really follows in it.

Scale: a search never leaves the words that share the three code points at its exact end, as the exact half has at least
three. So the vocabulary is dealt out by these, many small groups a shard, each shard has an index of its own and searches
its own words in it. A larger group is indexed in several blocks of at most ``SHARD`` words, and its words are searched in
all of them: no word is dropped, and the work of the largest group is spread. Words travel twice, texts only once, as counts.

A form has at least ten times the occurrences of its word, so chains of forms are short; roots follow them by joins of
the words whose form has one itself.

Defined results: null texts have no runs; a null doc_id counts as an empty text in the hash; a text's runs are all counted,
repeated rows too; ties between forms go to the first in code-point order; an empty table gives an empty result; extra
columns are ignored; runs of any length are words.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monsoon.llm.common import text_or_empty
from monsoon.session import cut_lineage

#: Runs of fewer code points can't be words: deleting one makes them shorter only.
LEAST_CHARS, LEAST_COUNT, TIMES = 7, 2, 10
RUN = r"[A-Za-zÀ-ÿ]{%d,}+" % LEAST_CHARS
#: One in so many runs, by its hash, loses a code point.
SLIP = 31
#: Code points that the exact part of every search has, and words of an index.
ANCHOR, SHARD = 3, 16_000


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n (occurrences) of all words of the texts, slips of the pen put in."""
    run = F.explode(F.regexp_extract_all(text_or_empty(F.col("text")), F.lit(RUN), F.lit(0))).alias("run")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), run)
    runs = runs.select("doc", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = F.expr("cast(h % length(run) as int)")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


class Index:
    """FM-index of delimited words for steps to the right: of the reversed text, where they lead to the left."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        """``codes`` are the words' code points one after the other, from 1 on; ``sizes`` their lengths."""
        starts = np.r_[0, np.cumsum(sizes)[:-1]] + np.arange(len(sizes)) + 1
        text = np.zeros(len(codes) + len(sizes) + 1, np.int64)
        text[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)) + 1, sizes)] = codes
        self.words = len(sizes)
        self.size = len(text)
        owner = np.zeros(self.size, np.int64)
        owner[starts[1:] - 1] = np.arange(len(sizes))[1:]
        owner = np.maximum.accumulate(owner)
        reverse = text[::-1]
        ranks = _rotation_ranks(reverse)
        order = np.empty(self.size, np.int64)
        order[ranks] = np.arange(self.size)
        self.bwt = reverse[order - 1]
        # The word whose closing delimiter a rotation of the reversed text begins with.
        self.word = owner[np.maximum(self.size - 1 - order - 1, 0)]
        # Places of each code point in the transform, so that one search is C + rank.
        self.sigma = int(text.max()) + 1
        self.places = np.sort(self.bwt * (self.size + 1) + np.arange(self.size))

    def step(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after a further code point on the right."""
        base = code * (self.size + 1)
        return np.searchsorted(self.places, base + low), np.searchsorted(self.places, base + high)


def _rotation_ranks(text: np.ndarray) -> np.ndarray:
    """Rank of each rotation, by doubling the compared length; two delimiters meet at one place only, so all are different."""
    ranks, length = text, 1
    while int(ranks.max()) < len(text) - 1:
        key = ranks * (int(ranks.max()) + 1) + np.roll(ranks, -length)
        _, ranks = np.unique(key, return_inverse=True)
        length *= 2
    return ranks


def search(index: Index, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, exact: np.ndarray, inside: np.ndarray):
    """Pairs (query, found word of the index) at one error after the first ``exact`` code points of each query.

    Query i is ``codes[starts[i] : starts[i] + sizes[i]]``; ``inside`` tells whether it is one of the index's words.
    """
    queries = np.arange(len(sizes))
    low, high = index.step(np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.full(len(sizes), index.size))
    found: list[np.ndarray] = []
    # Branches: query, next code point of it, interval.
    branches = [np.zeros(0, np.int64)] * 4
    at = 0
    while len(queries) or len(branches[0]):
        branches = _follow(index, codes, starts, sizes, branches, found)
        # A word alone in its interval has nobody to differ from.
        wide = (at >= exact[queries]) & (high - low > inside[queries])
        branches = _branch(index, codes, starts, sizes, branches, queries[wide], at, low[wide], high[wide])
        on = (at < sizes[queries]) & (high > low)
        queries, low, high = queries[on], low[on], high[on]
        low, high = index.step(codes[starts[queries] + at], low, high)
        at += 1
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
    return np.divmod(pairs, index.words)


def _branch(index, codes, starts, sizes, branches, queries, at, low, high):
    """The three errors at one place: a code point left out, replaced or put in."""
    inner = at < sizes[queries]
    out = [branches, [queries[inner], np.full(int(inner.sum()), at + 1), low[inner], high[inner]]]
    # Equal intervals branch alike.
    spans, which = np.unique(low * (index.size + 1) + high, return_inverse=True)
    span_low, span_high = np.divmod(spans, index.size + 1)
    letters = np.tile(np.arange(1, index.sigma), len(spans))
    span = np.repeat(np.arange(len(spans)), index.sigma - 1)
    new_low, new_high = index.step(letters, span_low[span], span_high[span])
    real = new_low < new_high
    span, letters, new_low, new_high = span[real], letters[real], new_low[real], new_high[real]
    begin = np.searchsorted(span, np.arange(len(spans) + 1))
    counts = np.diff(begin)[which]
    rows = np.repeat(np.arange(len(queries)), counts)
    child = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin[:-1][which], counts)
    q, c = queries[rows], letters[child]
    own = _code(codes, starts, sizes, q, at)
    # Put in before an equal code point it would be the same word as put in after it.
    other = c != own
    for part, further in ((other & (own > 0), at + 1), (other, at)):
        out.append([q[part], np.full(int(part.sum()), further), new_low[child[part]], new_high[child[part]]])
    return [np.concatenate(x) for x in zip(*out)]


def _code(codes, starts, sizes, queries, at):
    """Code points of the queries at a place, 0 (the delimiter) at their end."""
    ended = at >= sizes[queries]
    return np.where(ended, 0, codes[np.where(ended, 0, starts[queries] + at)])


def _follow(index, codes, starts, sizes, branches, found):
    """One exact step of all branches; those at their query's end must meet the delimiter."""
    q, at, low, high = branches
    if not len(q):
        return branches
    low, high = index.step(_code(codes, starts, sizes, q, at), low, high)
    ended = at >= sizes[q]
    real = low < high
    done, on = real & ended, real & ~ended
    found.append(q[done] * index.words + index.word[low[done]])
    return [q[on], at[on] + 1, low[on], high[on]]


COLUMNS = "word string, n_near bigint, form string, form_n bigint"


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words as small numbers in code-point order (from 1), and lengths."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    _, codes = np.unique(points, return_inverse=True)
    return codes.astype(np.int64) + 1, np.fromiter(map(len, words), np.int64, len(words))


def near_words(words: list[str], ns: np.ndarray, asked: np.ndarray, indexed: np.ndarray, backward: bool):
    """Of the asked words: how many of the indexed are near by this search, and the most frequent of them.

    The backward search leaves out what the forward one finds: words with the same first half.
    """
    turned = [w[::-1] for w in words] if backward else words
    codes, sizes = _coded(turned)
    starts = np.cumsum(sizes) - sizes
    of = np.flatnonzero(indexed)
    index = Index(codes[np.repeat(indexed, sizes)], sizes[of])
    ask = np.flatnonzero(asked)
    half = sizes[ask] // 2
    exact = sizes[ask] - half if backward else half
    q, u = search(index, codes, starts[ask], sizes[ask], exact, indexed[ask].astype(np.int64))
    q, u = ask[q], of[u]
    keep = q != u
    if backward:
        keep &= np.fromiter((words[a][: len(words[a]) // 2] != words[b][: len(words[a]) // 2] for a, b in zip(q, u)), bool, len(q))
    q, u = q[keep], u[keep]
    # Code-point order of the found words breaks ties.
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[u], -ns[u], q))
    q, u = q[order], u[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    return q[first], np.diff(np.r_[first, len(q)]), u[first]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; a shard's rows are held together, at most a few times SHARD."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        words, ns = t.column("word").to_pylist(), t.column("n").to_numpy()
        asked, indexed = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("asked", "indexed"))
        if not indexed.any():
            return
        backward = bool(t.column("backward")[0].as_py())
        wanted = np.flatnonzero(asked)
        for begin in range(0, len(wanted), SHARD):
            some = np.zeros(len(words), bool)
            some[wanted[begin : begin + SHARD]] = True
            q, counts, best = near_words(words, ns, some, indexed, backward)
            columns = [
                pa.array([words[i] for i in q], pa.string()), pa.array(counts, pa.int64()),
                pa.array([words[i] for i in best], pa.string()), pa.array(ns[best], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "form", "form_n"])

    held: list[pa.RecordBatch] = []
    current = None
    for b in batches:
        shard = b.column("shard").to_numpy()
        edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else np.zeros(0, int)
        for begin, end in zip(edges[:-1], edges[1:]):
            if shard[begin] != current and held:
                yield from run(pa.Table.from_batches(held))
                held = []
            current = shard[begin]
            held.append(b.slice(begin, end - begin))
    if held:
        yield from run(pa.Table.from_batches(held))


def _dealt(words: DataFrame, backward: bool, shard: int) -> DataFrame:
    """The words by shards of one direction: word, n, asked, indexed, backward, shard."""
    end = F.substring("word", -ANCHOR, ANCHOR) if backward else F.substring("word", 1, ANCHOR)
    keyed = words.select("word", "n", end.alias("anchor"))
    groups = cut_lineage(keyed.groupBy("anchor").agg(F.count("*").alias("size")))
    large = cut_lineage(groups.filter(F.col("size") > shard))
    rest = groups.filter(F.col("size") <= shard).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # Half full on average: groups are dealt by hash.
    shards = max(1, -(-2 * rest // shard))
    side = F.lit(backward).alias("backward")
    common = keyed.join(large, "anchor", "left")
    small = common.filter("size IS NULL").select(
        "word", "n", F.lit(True).alias("asked"), F.lit(True).alias("indexed"), side,
        F.xxhash64(F.lit(backward), F.lit("small"), F.pmod(F.xxhash64("anchor"), F.lit(shards))).alias("shard"),
    )
    blocks = F.ceil(F.col("size") / shard).cast("int")
    hot = common.filter("size IS NOT NULL").withColumns({"own": F.pmod(F.xxhash64("word"), blocks).cast("int"), "blocks": blocks})
    hot = hot.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hot = hot.select(
        "word", "n", F.lit(True).alias("asked"), (F.col("own") == F.col("block")).alias("indexed"), side,
        F.xxhash64(F.lit(backward), F.lit("hot"), "anchor", "block").alias("shard"),
    )
    return small.unionByName(hot)


def variants(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n), whose words are distinct."""
    known = cut_lineage(words.select("word", "n"))
    dealt = _dealt(known, False, shard).unionByName(_dealt(known, True, shard))
    sides = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards, COLUMNS)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    near = sides.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    near = cut_lineage(near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")))
    chosen = F.col("form_n") >= TIMES * F.col("n")
    judged = known.join(near, "word", "left").select(
        "word", F.when(chosen, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(chosen, F.col("form_n")).alias("form_n"),
    )
    judged = cut_lineage(judged)
    return _with_roots(judged)


def _with_roots(judged: DataFrame) -> DataFrame:
    links = cut_lineage(judged.filter("form IS NOT NULL").select("word", "form"))
    step = links.select(F.col("word").alias("root"), F.col("form").alias("further"))
    roots, moving = links.select("word", F.col("form").alias("root")), True
    # Each round follows one more form; counts grow tenfold with each.
    while moving:
        moved = cut_lineage(roots.join(step, "root", "left"))
        moving = not moved.filter("further IS NOT NULL").isEmpty()
        roots = moved.select("word", F.coalesce("further", "root").alias("root"))
    found = judged.join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
