"""Mixing sources to target weights with Sainte-Lague apportionment of equal blocks of words.

Sources share ``share`` times all words by weight; a target stops at ``most`` times its source and what is over goes to
the others. Documents are hashed into shards of bounded size, the words of a shard are cut into blocks of equal size,
and blocks are given out to the highest quotients target / (2 seats + 1): first among the sources, then among the
shards of a source. Which blocks of a shard a quota takes is a seeded permutation of the block numbers, so it needs no
sort and no join. Only ids and sizes are shuffled, never texts.

Defined results: a null text has no words and nothing of it is taken; null sources form one source, the last; a null
doc_id is an id like any other; equal rows are documents of their own; without any words all targets are 0. Extra
columns are ignored. Reruns on the same rows give the same result whatever the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monsoon.llm.common import WORD, text_or_empty
from monsoon.session import cut_lineage

#: A prime above any number of blocks in a shard, so that multiples of it visit every block once.
STEP = 2_147_483_647
#: Levels compared in one pass over the sources, and passes before what is left counts as a tie.
LEVELS, PASSES = 32, 12


def _seed(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def targets(
    sources: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Adds ``target`` to (source, source_size): one row per source, so this table is small next to the documents."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = cut_lineage(
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
    )
    full = F.col("source_size") * F.lit(float(most))
    level, total = 0.0, None
    while True:
        over = full <= F.col("weight") * F.lit(level)
        row = weighed.agg(
            F.sum("source_size").alias("size"),
            F.sum(F.when(over, full)).alias("full"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
        ).first()
        total = (row["size"] or 0) * share
        if not row["weight"]:
            break
        rises = (total - (row["full"] or 0.0)) / row["weight"]
        if rises <= level:
            break
        level = rises
    return weighed.withColumn("target", F.least(full, F.col("weight") * F.lit(level)))


def seats(sources: DataFrame, block: int, most: float) -> DataFrame:
    """Adds ``seats``: the blocks of all targets together, given to the sources of the highest quotients target / (2 seats + 1).

    A source has as many seats as it has quotients above a level. The level at which they add up is narrowed by passes over
    the table of sources, some levels a pass; equal quotients at the level go by the sources' order.
    """
    cap = F.ceil(F.col("source_size") / F.lit(block)) * int(most)
    above = lambda level: F.least(cap, F.floor(F.col("target") / F.lit(float(level)) + 0.5))
    row = sources.agg(
        F.sum("target").alias("all"), F.max("target").alias("top"), F.count_if(F.col("target") > 0).alias("n")
    ).first()
    wanted = math.floor((row["all"] or 0.0) / block + 0.5)
    if not wanted:
        return sources.withColumn("seats", F.lit(0).cast("long"))
    # Rounding adds or takes half a seat a source at most, which bounds the level.
    low = block / (1 + (row["n"] + 2) / wanted)
    high = row["all"] / (wanted - row["n"] / 2) if wanted > row["n"] / 2 else 2 * row["top"] + 1
    for _ in range(PASSES):
        levels = [low + (high - low) * i / LEVELS for i in range(1, LEVELS)] + [high]
        sums = sources.agg(*[F.sum(above(x)).alias(f"s{i}") for i, x in enumerate(levels)]).first()
        k = next((i for i, n in enumerate(sums) if n <= wanted), LEVELS - 1)
        low, high = levels[k - 1] if k else low, levels[k]
        if sums[k] == wanted:
            break
    made = sources.withColumn("seats", above(high).cast("long"))
    next_one = F.when(F.col("seats") < cap, F.col("target") / (2 * F.col("seats") + 1))
    order = Window.orderBy(next_one.desc_nulls_last(), F.col("source").isNull(), "source")
    more = F.row_number().over(order) <= wanted - sums[k]
    return made.withColumn("seats", F.col("seats") + F.when(more & (F.col("seats") < cap), 1).otherwise(0))


def _quotas(shards: DataFrame, block: int, most: float) -> DataFrame:
    """Adds ``blocks`` and the integer ``quota`` of every shard; the quotas of a source add up to its seats."""
    # The shard's part of its source's seats: quotients of it are in the order of those of the target.
    own = F.col("seats") * F.lit(block) * F.col("shard_size") / F.greatest(F.col("source_size"), F.lit(1))
    rounded = F.floor(own / block + 0.5)
    every = Window.partitionBy("source")
    made = (
        shards.withColumn("blocks", F.ceil(F.col("shard_size") / F.lit(block)).cast("long"))
        .withColumn("_own", own)
        .withColumn("_first", F.least(rounded, F.col("blocks") * int(most)))
        .withColumn("_left", F.col("seats") - F.sum("_first").over(every))
    )
    gives = F.when(F.col("_first") < F.col("blocks") * int(most), F.col("_own") / (2 * F.col("_first") + 1))
    takes = F.when(F.col("_first") > 0, F.col("_own") / (2 * F.col("_first") - 1))
    made = made.withColumn("_gives", gives).withColumn("_takes", takes)
    up = F.row_number().over(every.orderBy(F.col("_gives").desc_nulls_last(), "shard"))
    down = F.row_number().over(every.orderBy(F.col("_takes").asc_nulls_last(), "shard"))
    made = made.withColumn("_up", up).withColumn("_down", down)
    change = F.when((F.col("_left") >= F.col("_up")) & F.col("_gives").isNotNull(), 1).when(
        (-F.col("_left") >= F.col("_down")) & F.col("_takes").isNotNull(), -1
    )
    made = made.withColumn("quota", (F.col("_first") + F.coalesce(change, F.lit(0))).cast("long"))
    return made.drop("_own", "_first", "_left", "_gives", "_takes", "_up", "_down")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 32,
    shard_words: int = 1_000_000,
    seed: int = 20,
) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, shard, first_word of its words in the shard, taken."""
    if int(most) != most:
        raise ValueError("most must be a whole number")
    sizes = cut_lineage(
        docs.select(
            "doc_id", F.col("source").cast("string").alias("source"),
            F.regexp_count(text_or_empty(F.col("text")), F.lit(WORD)).cast("long").alias("size"),
        )
    )
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        # Empty documents count too, or a source of them would make one endless shard.
        F.ceil((F.sum("size") + F.count("*")) / F.lit(shard_words)).cast("long").alias("shards"),
    )
    sources = seats(targets(sources, weights, share, most).drop("weight"), block, most)
    placed = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    placed = placed.select(
        "doc_id", "size", F.col("d.source").alias("source"), "source_size", "target", "seats",
        F.pmod(_seed(seed, F.col("doc_id"), F.col("size")), F.col("shards")).alias("shard"),
    )
    shards = placed.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.first("seats").alias("seats"),
    )
    quotas = _quotas(shards, block, most).select("source", "shard", "blocks", "quota")
    order = Window.partitionBy("source", "shard").orderBy(_seed(seed + 1, F.col("doc_id")), "doc_id", "size")
    ends = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn("_end", ends).withColumn("first_word", F.col("_end") - F.col("size"))
    both = placed.alias("p").join(
        quotas.alias("q"),
        F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.shard") == F.col("q.shard")),
    )
    start, end, blocks = F.col("first_word"), F.col("_end"), F.col("blocks")
    offset = F.pmod(_seed(seed + 2, F.col("p.source"), F.col("p.shard")), blocks)
    extra = F.pmod(F.col("quota"), blocks)
    chosen = F.filter(
        F.sequence(F.floor(start / block), F.floor((end - 1) / block)),
        lambda k: F.pmod(k * F.lit(STEP) + F.col("_offset"), F.col("blocks")) < F.col("_extra"),
    )
    overlap = F.aggregate(
        chosen,
        F.lit(0).cast("long"),
        lambda acc, k: acc + F.least(F.col("_end"), (k + 1) * block) - F.greatest(F.col("first_word"), k * block),
    )
    taken = F.when(F.col("size") > 0, F.floor(F.col("quota") / blocks) * F.col("size") + overlap).otherwise(0)
    return both.withColumn("_offset", offset).withColumn("_extra", extra).select(
        "doc_id", "size", F.col("p.source").alias("source"), "source_size", "target", F.col("p.shard").alias("shard"),
        "first_word", taken.cast("long").alias("taken"),
    )
