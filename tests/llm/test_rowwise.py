"""Quality cascade, licence index, toxicity: results by row against plain Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from monsoon.llm import license_scan, quality_cascade, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def facts(text):
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
    }


def test_quality_facts(odd_docs, small):
    texts = ["a b c d e a b c d e f", "q w e r t " * 400, "#% | & <x> *", "l one\nl one\n\nl two\nl one", "a b c d e " * 2 + "x"]
    spark = odd_docs.sparkSession
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more).unionByName(small["documents"].select("doc_id", "text"))
    got = Counter(tuple(r) for r in quality_cascade.assess(docs).select("doc_id", *facts(""), "base_failed").collect())
    want = Counter()
    for doc_id, text in docs.collect():
        f = facts(text)
        failed = f["n_words"] < 10 or 100 * f["n_repeat_words"] > 20 * f["n_words"]
        want[(doc_id, *f.values(), failed)] += 1
    assert got == want


def test_quality_verdict_and_cascade(odd_docs):
    verdict = quality_cascade.assess(odd_docs)
    assert verdict.filter("base_failed and kept").isEmpty()
    order = quality_cascade.estimate(odd_docs, fraction=1.0)
    assert [e.rejects / e.cost for e in order] == sorted((e.rejects / e.cost for e in order), reverse=True)
    named = quality_cascade.cascade(odd_docs, order)
    assert named.columns == [*odd_docs.columns, "failed_rule"]
    kept = sorted(str(r[0]) for r in verdict.filter("kept").select("doc_id").collect())
    assert kept == sorted(str(r[0]) for r in named.filter("failed_rule is null").select("doc_id").collect())
    # The order decides which rule is named, never the verdict.
    other = quality_cascade.cascade(odd_docs, order[::-1]).filter("failed_rule is null").select("doc_id").collect()
    assert sorted(str(r[0]) for r in other) == kept
    with pytest.raises(ValueError, match="taken"):
        quality_cascade.cascade(named, order)


def test_quality_plan_is_native(odd_docs, no_docs):
    plan = quality_cascade.assess(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert quality_cascade.assess(no_docs).isEmpty()


def base_places(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    found = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


NOTICES = [
    "CC BY cc-by CC\nby x All rights, reserved. all rights all rights reserved",
    "General Public License general public general public license",
    "Licensed under CC BY-NC 4.0.",
    "foo Released under the MIT License. bar",
    "the mit of license", "CC", "by cc", "écc by", "Licensed under the Apache License, Version 2.0.",
]


def test_license_base(odd_docs, small):
    spark = odd_docs.sparkSession
    more = spark.createDataFrame([(90_100 + i, t) for i, t in enumerate(NOTICES)], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more).unionByName(small["documents"].select("doc_id", "text"))
    got = license_scan.scan(docs)
    rows = got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert Counter(map(tuple, rows)) == Counter((i, *base_places(t)) for i, t in docs.collect())
    assert got.filter("score < 0 or score > 1 or (labels = '' and score > 0)").isEmpty()
    labels = {r["doc_id"] - 90_000: r["labels"] for r in got.filter("doc_id >= 90000").collect()}
    assert labels[102] == "cc-by,cc-by-nc-4.0" and labels[103] == "mit" and labels[108] == "apache-2.0"
    assert labels[104] == labels[105] == labels[106] == labels[107] == ""


def test_license_empty(no_docs):
    assert license_scan.scan(no_docs).isEmpty()


def test_machine_learns_pairs():
    rng = np.random.default_rng(1)
    hasher = toxicity.Hasher()
    texts, toxic = [], []
    for _ in range(1200):
        a, b = rng.random(2) < 0.5
        noise = [f"n{'abcdefghij'[i]}" for i in rng.integers(0, 10, 4)]
        texts.append(" ".join(["red"] * int(a) + ["stone"] * int(b) + noise))
        toxic.append(float(a and b))
    rows, toxic = [hasher(t) for t in texts], np.array(toxic)
    machine = toxicity.fit(rows[:900], toxic[:900])
    assert ((machine.score(rows[900:]) >= 0.5) == (toxic[900:] == 1)).mean() > 0.98


def _told_in_pairs(rule, noise=4, n=4000, seed=4, dull=0):
    """Share of rows right that weren't learnt: two terms in half of the texts, among others."""
    rng = np.random.default_rng(seed)
    hasher = toxicity.Hasher()
    rows, toxic = [], []
    for _ in range(n):
        a, b = rng.random(2) < 0.5
        others = [f"n{chr(97 + i)}{chr(97 + j)}" for i, j in rng.integers(0, 26, (noise, 2))] + ["dull"] * dull
        rows.append(hasher(" ".join(["red"] * int(a) + ["stone"] * int(b) + others)))
        toxic.append(float(rule(a, b)))
    learnt, toxic = n * 4 // 5, np.array(toxic)
    machine = toxicity.fit(rows[:learnt], toxic[:learnt])
    return ((machine.score(rows[learnt:]) >= 0.5) == (toxic[learnt:] == 1)).mean()


@pytest.mark.parametrize("noise", [0, 4, 60])
@pytest.mark.parametrize("rule", [lambda a, b: a == b, lambda a, b: a != b, lambda a, b: a and not b])
def test_machine_learns_pairs_of_even_terms(rule, noise):
    """Each of both terms is as frequent in clean as in toxic texts (in the first two rules), so only the pair tells."""
    assert _told_in_pairs(rule, noise) > 0.97


def test_pairs_by_chance_are_left():
    """Labels that nothing tells: no term gets a weight."""
    rng = np.random.default_rng(9)
    rows = [np.sort(rng.choice(600, 60, replace=False)) for _ in range(3000)]
    toxic = (rng.random(3000) < 0.2).astype(float)
    assert len(toxicity.telling_pairs(rows, toxic, np.full(3000, toxic.mean()), np.arange(600), 1 << 18, 15.0)) == 0


def test_pairs_equal_their_definition():
    rng = np.random.default_rng(11)
    rows = [np.flatnonzero(rng.random(12) < 0.5) for _ in range(700)]
    toxic = np.array([float(3 in r and 7 in r) if rng.random() < 0.9 else 0.0 for r in rows])
    expected = np.clip(rng.normal(toxic.mean(), 0.05, 700), 0.01, 0.99)
    terms = np.array([1, 3, 5, 7, 9])
    least, want = 15 + 2 * np.log(10), set()
    spread = np.clip(expected, 0.05, 0.95)
    for i in terms:
        for j in terms:
            own = [k for k, r in enumerate(rows) if i in r and j in r]
            if i < j and (toxic - expected)[own].sum() ** 2 > least * (spread * (1 - spread))[own].sum():
                want |= {int(i), int(j)}
    assert {3, 7} <= want == set(toxicity.telling_pairs(rows, toxic, expected, terms, 16, 15.0).tolist())


def test_machine_score_equals_its_definition():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(0.3, rng.normal(size=64), rng.normal(size=(64, 3)))
    rows = [np.array(r, np.int64) for r in ([], [3], [1, 5, 9], [0, 2, 4, 63])]
    for r, got in zip(rows, m.score(rows)):
        raw = m.bias + m.weights[r].sum() + sum(m.factors[i] @ m.factors[j] for i in r for j in r if i < j)
        assert got == pytest.approx(1 / (1 + np.exp(-raw)))


def test_toxicity_query(odd_docs, no_docs, small):
    spark = odd_docs.sparkSession
    other = ("river", "stone", "cloud", "table", "green", "seven", "paper")
    rows = [(1000 + i, f"some words {'idiot' if i % 3 == 0 else other[i % 7]} more words {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd_docs.select("doc_id", "text"))
    labels = spark.createDataFrame(
        [(i, int("idiot" in t), 1) for i, t in rows] + [(None, 1, 1), (1, None, 0), (1000, 1, 0)], "doc_id bigint, toxic int, quality int"
    )
    machine = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, machine).collect()
    assert len(got) == 300 + odd_docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] and r["doc_id"] >= 1000:
            assert r["predicted"] == int((r["doc_id"] - 1000) % 3 == 0)
    assert toxicity.score_documents(no_docs, machine).isEmpty()
    kept = toxicity.drop_toxic(odd_docs.withColumn("_toxicity", F.lit(1)), machine)
    assert kept.count() == odd_docs.count() and kept.columns == [*odd_docs.columns, "_toxicity"]
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score_documents(docs, none).filter("predicted = 1").isEmpty()


def test_toxicity_never_learns_held_out_labels(spark):
    rows = [(i, f"plain text number {'abcdefghij'[i % 10]}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(zlib.crc32(str(i).encode()) % 5 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    assert toxicity.train(docs, labels).bias == -10.0
