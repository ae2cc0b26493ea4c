"""Quality rules as a short-circuit cascade ordered by rejections per cost.

Every rule is a Boolean expression over text facts. ``estimate`` measures, on a sample, how often each rule rejects and
how much work it does; ``cascade`` then evaluates the rules in the order of rejections per unit of work, and stops at
the first one that rejects a text: ``coalesce`` evaluates its arguments one after the other, and a fact is part of the
rule that needs it. ``assess`` returns the facts of every text as well, so there the order saves nothing; the
verdict is the same. Built-in functions only.

Defined results: a null text has no words, so it fails the rule of the fewest words. Equal rows get equal results. An
empty table gives an empty result; the order of the rules is then the given one. Extra columns are ignored by
``assess`` and kept by ``cascade``, unless the name of the added column is taken, which raises ValueError.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monsoon.llm.common import BLANKS, let, text_or_empty, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``fails`` is true where a text is to go. ``facts`` names what it reads; ``cost`` is the work per character."""

    name: str
    facts: tuple[str, ...]
    fails: Callable[[dict[str, Column]], Column]
    cost: float


#: Work per character relative to one pass that copies the text. A split text costs more, hashed windows most.
RULES = (
    Rule("few_words", ("n_words",), lambda f: f["n_words"] < 10, 4.0),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda f: 100 * f["n_repeat_words"] > 20 * f["n_words"], 20.0),
    Rule("symbols", ("n_words", "n_symbols"), lambda f: 10 * f["n_symbols"] > f["n_words"], 5.0),
    Rule("shouting", ("word_chars", "n_upper"), lambda f: 10 * f["n_upper"] > 4 * f["word_chars"], 4.0),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), lambda f: 2 * f["n_dup_lines"] > f["n_lines"], 3.0),
    Rule(
        "word_length",
        ("n_words", "word_chars"),
        lambda f: ~f["word_chars"].between(2 * f["n_words"], 20 * f["n_words"]),
        5.0,
    ),
)
BASE_RULES = ("few_words", "repeats")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_windows(ordered: Column) -> Column:
    """Start positions, ascending, of the windows found twice or more; ``ordered`` has (hash, position), sorted."""

    def same(all_: Column) -> Column:
        near = lambda x, i: F.get(all_, i)["h"].eqNullSafe(x["h"])
        return F.filter(all_, lambda x, i: near(x, i - 1) | near(x, i + 1))

    return F.sort_array(F.transform(let(ordered, same), lambda x: x["i"]))


def window_hashes(w: Column) -> Column:
    """Hash of every window of a word array that has at least one."""
    at = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    return let(w, lambda own: F.transform(at, lambda i: F.xxhash64(F.slice(own, i, WINDOW))))


def covered_words(starts: Column) -> Column:
    """Number of words inside windows that start at these ascending positions."""
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        starts,
        zero,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def _facts(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """All facts of every text, in steps, so that no array is built twice."""
    t, w, lines, hashes, ordered, starts = (F.col(c) for c in ("_t", "_w", "_lines", "_hashes", "_ordered", "_starts"))
    kept = [f"_k{i}" for i in range(len(keep))]
    step = docs.select(*[c.alias(k) for c, k in zip(keep, kept)], text_or_empty(F.col("text")).alias("_t"))
    step = step.select(
        "*",
        words(t).alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: _without(x, BLANKS) > 0).alias("_lines"),
    )
    step = step.select(
        *kept,
        F.size(w).cast("long").alias("n_words"),
        _without(t, BLANKS).cast("long").alias("word_chars"),
        (F.length(t) - _without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) >= WINDOW, window_hashes(w)).alias("_hashes"),
    )
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    step = step.withColumn(
        "_ordered", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(pairs))
    ).drop("_hashes")
    step = step.withColumn("_starts", F.when(ordered.isNotNull(), repeated_windows(ordered))).drop("_ordered")
    step = step.withColumn("n_repeat_words", F.coalesce(covered_words(starts), F.lit(0)).cast("long"))
    return step.drop("_starts")


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejects: float
    cost: float


FACTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, fraction: float = 0.02, seed: int = 7) -> list[Estimate]:
    """The rules in the order to run them: the share of sampled texts a rule rejects over its work per text.

    The sample serves this order alone and never a verdict.
    """
    sample = _facts(docs.select("text").sample(fraction=fraction, seed=seed), [])
    facts = {c: F.col(c) for c in FACTS}
    row = sample.agg(
        F.avg("word_chars").alias("chars"), *[F.avg(r.fails(facts).cast("double")).alias(r.name) for r in rules]
    ).first()
    found = [Estimate(r, row[r.name] or 0.0, r.cost * ((row["chars"] or 0.0) + 1.0)) for r in rules]
    return sorted(found, key=lambda e: -e.rejects / e.cost)


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES, fraction: float = 0.02) -> DataFrame:
    """Facts and verdict of every text: doc_id, the facts, failed_base, and kept."""
    order = estimate(docs, rules, fraction)
    facts = {c: F.col(c) for c in FACTS}
    base = F.lit(False)
    for r in rules:
        if r.name in BASE_RULES:
            base = base | r.fails(facts)
    rejected = F.coalesce(*[F.when(e.rule.fails(facts), F.lit(True)) for e in order], F.lit(False))
    return _facts(docs, [F.col("doc_id")]).select(
        F.col("_k0").alias("doc_id"), *FACTS, base.alias("base_failed"), (~base & ~rejected).alias("kept")
    )


def _inline(text: Column) -> dict[str, Column]:
    """The facts as plain expressions, each evaluated only where a rule is reached."""
    t = text_or_empty(text)
    w = words(text)
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, BLANKS) > 0)

    def repeats(w: Column) -> Column:
        pairs = F.transform(window_hashes(w), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return covered_words(repeated_windows(F.sort_array(pairs)))

    return {
        "n_words": F.size(w),
        "word_chars": _without(t, BLANKS),
        "n_symbols": F.length(t) - _without(t, SYMBOLS),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": let(w, lambda x: F.when(F.size(x) >= WINDOW, repeats(x)).otherwise(0)),
    }


def cascade(docs: DataFrame, order: list[Estimate], column: str = "failed_rule") -> DataFrame:
    """``docs`` with the name of the first rule that rejects a text, null for texts to keep."""
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the column {column} is taken")
    facts = _inline(F.col("text"))
    return docs.withColumn(column, F.coalesce(*[F.when(e.rule.fails(facts), F.lit(e.rule.name)) for e in order]))
