"""Benchmark decontamination by template canonicalisation. Built-in functions only.

Texts become templates word by word: numbers, units after numbers, and names (capitalised words inside a sentence) turn
into typed placeholders; other words are lower-cased without closing punctuation. Windows of ``WINDOW`` template words
of the items are joined by hash with those of the documents. Where a window matched, the values behind the placeholders are
compared, without closing punctuation: along one alignment an item's value must always stand for the same value of the
document, as in a question with exchanged parameters. Windows over places that differ from most places of their value
(over all of them if none prevails) don't count. What remains is measured as the share of the item's words under matched windows;
from ``least`` on the document is contaminated by the item.

Scale: the windows of a document are hashed in its row and exploded with its key alone. The items' windows are counted
first: up to ``SMALL`` rows they are broadcast, above both sides are shuffled by hash. Equal items are one item from the
start, so copies in the benchmark multiply nothing, and matches are grouped by document and item, whose size is bounded
by the item. Only texts with a match are read again for their values.

Defined results: null and empty texts match nothing, and so do items without words; items shorter than a window match as
a whole; equal rows of ``documents`` count as one; several items with one template are reported under the smallest
item_id; a null doc_id or item_id is a value like any other. Empty tables give an empty result; extra columns are
ignored, or kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monsoon.llm.common import SPACE, broadcast_if_small, let, row_key, text_or_empty, words
from monsoon.session import cut_lineage

WINDOW = 8
LEAST = 0.5
#: Rows of 24 bytes that may be broadcast.
SMALL = 500_000

#: Placeholders: characters of the private use area, which texts hardly hold; one that does hold them just matches less.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
#: Units of measure and money. Fixed values.
UNITS = (
    "kg g mg lb lbs oz km m cm mm mi ft in inch inches mile miles meter meters metre metres foot feet l ml litre litres "
    "liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd "
    "eur gbp dollar dollars euro euros pound pounds cent cents percent % $ € £ °c °f mph kmh km/h w kw kwh v mb gb tb"
).split()


def template(text: Column) -> Column:
    """The words of a text as template words, one for each of ``words(text)``."""
    t = F.regexp_replace(text_or_empty(text), f"[{NUMBER}-{NAME}]", "?")
    # Names and units are told by what stands before their blank, so a text may be wrapped anywhere. The replacements below
    # keep every blank, so words stay aligned with those of the text.
    t = F.regexp_replace(t, SPACE, " ")
    t = F.regexp_replace(t, r"(?<=[\p{Ll},;] )\p{Lu}[\p{Ll}'’-]+", NAME)
    t = F.regexp_replace(t, r"(?<![\p{L}\d])[+-]?\d+(?:[.,:/]\d+)*", NUMBER)
    units = "|".join(sorted((u.replace("$", r"\$") for u in UNITS), key=len, reverse=True))
    t = F.regexp_replace(F.lower(t), rf"(?<={NUMBER}[ -]?)(?:{units})(?![\p{{L}}\d])", UNIT)
    t = F.regexp_replace(t, rf"(?<=[\p{{L}}\p{{N}}{NUMBER}-{NAME}])[.,;:!?]+(?=[\x20\x09-\x0D]|$)", "")
    return F.array_remove(F.split(t, SPACE), "")


def windows(template_words: Column, size: int) -> Column:
    """Hash of every window of ``size`` words; none if there are fewer words."""
    at = F.sequence(F.lit(1), F.size(template_words) - (size - 1))
    hashes = let(template_words, lambda own: F.transform(at, lambda i: F.xxhash64(F.slice(own, i, size))))
    return F.when(F.size(template_words) >= size, hashes)


def _items(benchmark: DataFrame) -> DataFrame:
    """One row per different template: item_id, its words and template words, and the size of its windows."""
    own = benchmark.select(F.col("item_id"), words(F.col("text")).alias("raw"), template(F.col("text")).alias("t"))
    own = own.filter(F.size("t") > 0).withColumn("item", F.xxhash64("t"))
    first = own.groupBy("item").agg(F.min("item_id").alias("item_id"), F.min_by(F.struct("raw", "t"), F.struct("item_id", "raw")).alias("w"))
    return first.select("item", "item_id", "w.raw", "w.t", F.least(F.size("w.t"), F.lit(WINDOW)).alias("size"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Matched windows: key of the document, doc_id, item, at (in the item) and diagonal (in the document less at)."""
    spread = items.select("item", "size", "t")
    base = docs.select(
        F.col("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), template(F.col("text")).alias("t")
    )
    # Short items have windows of their own sizes: at most WINDOW different ones.
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    found = None
    for size in sizes:
        theirs = spread.filter(F.col("size") == size).select("item", F.posexplode_outer(windows(F.col("t"), size)).alias("at", "hash"))
        theirs = cut_lineage(theirs)
        own = base.select("doc_id", "key", windows(F.col("t"), size).alias("h"))
        # The outer form: Spark would else filter by the size of the array first, and build it twice.
        own = own.select("doc_id", "key", F.posexplode_outer("h").alias("place", "hash"))
        met = own.join(broadcast_if_small(theirs, theirs.count(), SMALL), "hash")
        met = met.select("doc_id", "key", "item", "at", (F.col("place") - F.col("at")).alias("diagonal"))
        found = met if found is None else found.unionByName(met)
    if found is None:  # no items
        found = base.select("doc_id", "key", F.lit(0).cast("long").alias("item"), F.lit(0).alias("at"), F.lit(0).alias("diagonal")).limit(0)
    return found


def _value(word: Column) -> Column:
    """A word without closing punctuation, which ``template`` takes off too (there, signs of units are placeholders)."""
    return F.regexp_replace(word, r"(?<=[\p{L}\p{N}%$€£])[.,;:!?]+$", "")


def _consistent(hits: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The alignments (key, doc_id, item, diagonal) with those of their matched places whose placeholders agree."""
    aligned = cut_lineage(
        hits.groupBy("key", "doc_id", "item", "diagonal").agg(F.sort_array(F.collect_set("at")).alias("at"))
    )
    # Item positions under matched windows that hold a placeholder, with the item's value.
    slots = items.select(
        "item", "size",
        F.filter(
            F.transform(
                F.arrays_zip("t", "raw"), lambda x, i: F.struct(i.alias("i"), x["t"].alias("kind"), x["raw"].alias("value"))
            ),
            lambda s: s["kind"].rlike(f"[{NUMBER}-{NAME}]"),
        ).alias("slots"),
    )
    held = aligned.join(broadcast_if_small(slots, slots.count(), SMALL // 10), "item")
    under = F.filter(
        F.col("slots"), lambda s: F.exists(F.col("at"), lambda a: (a <= s["i"]) & (s["i"] < a + F.col("size")))
    )
    held = held.withColumn("slots", under)
    held = cut_lineage(held)
    asked = held.filter(F.size("slots") > 0)
    keys = asked.select("key").distinct()
    keys = cut_lineage(keys)
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    texts = texts.join(broadcast_if_small(keys, keys.count(), SMALL), "key").dropDuplicates(["key"])
    texts = texts.select("key", words(F.col("text")).alias("w"))
    pairs = asked.join(texts, "key").select(
        "key", "item", "diagonal",
        F.explode(
            F.transform(
                "slots",
                lambda s: F.struct(
                    s["i"].alias("i"), s["kind"].alias("kind"), _value(s["value"]).alias("value"),
                    _value(F.get("w", s["i"] + F.col("diagonal"))).alias("own"),
                ),
            )
        ).alias("s"),
    )
    # Everything collected here is bounded by the item.
    per_own = pairs.groupBy("key", "item", "diagonal", "s.kind", "s.value", "s.own").agg(
        F.count("*").alias("n"), F.collect_list("s.i").alias("places")
    )
    per_value = per_own.groupBy("key", "item", "diagonal", "kind", "value").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("n", "places", (F.col("own") != F.col("value")).alias("exchanged"))).alias("own")
    )
    prevails = lambda g: g["n"] * 2 > F.col("total")
    per_value = per_value.select(
        "key", "item", "diagonal", F.get(F.filter("own", prevails), F.lit(0)).alias("good"),
        F.flatten(F.transform(F.filter("own", lambda g: ~prevails(g)), lambda g: g["places"])).alias("bad"),
    )
    judged = per_value.groupBy("key", "item", "diagonal").agg(
        F.collect_list("good").alias("good"), F.flatten(F.collect_list("bad")).alias("bad")
    )
    over = lambda a, i: (a <= i) & (i < a + F.col("size"))
    held = held.join(judged, ["key", "item", "diagonal"], "left")
    held = held.withColumn("at", F.when(
        F.size("bad") > 0, F.filter("at", lambda a: ~F.exists("bad", lambda i: over(a, i)))
    ).otherwise(F.col("at")))
    held = cut_lineage(held.filter(F.size("at") > 0))
    # Values that only stand under windows that have gone don't count.
    held = held.withColumn("good", F.when(
        F.size("bad") > 0,
        F.filter("good", lambda g: F.exists(g["places"], lambda i: F.exists("at", lambda a: over(a, i)))),
    ).otherwise(F.col("good")))
    held = cut_lineage(held)
    exchanged = F.size(F.filter("good", lambda g: g["exchanged"]))
    return held.select(
        "key", "doc_id", "item", "diagonal", "at", "size",
        F.when(F.col("good").isNull(), 0).otherwise(exchanged).alias("exchanged"),
        F.when(F.col("good").isNull(), 0).otherwise(F.size("good")).alias("n_slots"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs of document and item from ``least`` on: key, doc_id, item_id, n_windows, coverage, n_slots, exchanged."""
    items = cut_lineage(_items(benchmark))
    good = _consistent(matches(docs, items), docs, items)
    joined = good.groupBy("key", "doc_id", "item").agg(
        # A place of an item counts once however often the document repeats it, so this is bounded by the item.
        F.sort_array(F.flatten(F.collect_set("at"))).alias("at"), F.max("size").alias("size"),
        F.max("n_slots").alias("n_slots"), F.max("exchanged").alias("exchanged"),
    )
    joined = joined.withColumn("at", F.array_distinct("at"))
    zero = F.struct(F.lit(-(10**9)).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "at", zero,
        lambda acc, a: F.struct(a.alias("last"), (acc["n"] + F.least(F.col("size"), a - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    own = items.select("item", "item_id", F.size("t").alias("item_words"))
    joined = joined.withColumn("covered", covered).join(own, "item")
    joined = joined.withColumn("coverage", F.col("covered") / F.col("item_words"))
    return joined.filter(F.col("coverage") >= least).select(
        "key", "doc_id", "item_id", F.size("at").cast("long").alias("n_windows"), "coverage",
        F.col("n_slots").cast("long").alias("n_slots"), F.col("exchanged").cast("long").alias("exchanged"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` without contaminated documents, with all their columns."""
    bad = cut_lineage(contaminated(docs, benchmark, least).select(F.col("key").alias("_bad")).distinct())
    own = docs.alias("d")
    match = row_key(F.col("d.doc_id"), F.col("d.text")) == F.col("_bad")
    return own.join(broadcast_if_small(bad, bad.count(), SMALL), match, "left_anti")
