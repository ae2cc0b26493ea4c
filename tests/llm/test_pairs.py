"""Near duplicates, line deduplication and decontamination against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from monsoon.llm import decontamination, line_dedup, near_duplicates
from monsoon.llm.near_duplicates import banded_distance, similar, word_hashes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(0, 14)).astype(np.uint64) for _ in range(2))
        most = int(rng.integers(0, 8))
        assert banded_distance(a, b, most) == min(distance(a.tolist(), b.tolist()), most + 1)


def test_similar_equals_the_distance():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
        b = [x if rng.random() < 0.85 else rng.choice("xyz") for x in a if rng.random() < 0.95] or ["q"]
        want = 1 - distance(a, b) / max(len(a), len(b)) >= 0.8 - 1e-9
        assert similar(word_hashes(" ".join(a)), word_hashes(" ".join(b))) == want


def prose(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]


def edited(rng, words, share):
    return [w if rng.random() >= share else "".join(rng.choice("stuvw") for _ in range(5)) for w in words]


def closed(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups = defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return {n: min(g) for g in groups.values() for n in g}


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies, a chain, docs with a common passage, and lone docs."""
    rng = random.Random(8)
    texts, common = [], prose(rng, 30)
    for size in (2, 3, 40):
        base = prose(rng, 120)
        texts += [" ".join(edited(rng, base, 0.03 * (k > 0))) for k in range(size)]
    chain = prose(rng, 100)
    for _ in range(5):
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 0.06)
    texts += [" ".join(prose(rng, 60) + common + prose(rng, 60)) for _ in range(40)]
    texts += [" ".join(prose(rng, rng.randint(1, 9))) for _ in range(20)]
    half = prose(rng, 100)
    texts += [" ".join(half), " ".join(half[50:] + half[:50])]  # same shingles, other order
    texts += [texts[0]] * 4
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_equal_brute_force(spark, copies, odd_docs):
    docs = spark.createDataFrame(copies, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicate_classes(docs).collect()}
    hashes = {i: word_hashes(t) for i, t in copies}
    links = [(a, b) for a in hashes for b in hashes if a < b and similar(hashes[a], hashes[b])]
    want = closed(hashes, links)
    assert {i: r["class_id"] for i, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got.values())


def test_near_duplicates_of_odd_texts(odd_docs, no_docs):
    rows = near_duplicates.near_duplicate_classes(odd_docs).collect()
    got = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in rows)
    assert got[(6, 6, 3)] == 2 and got[(7, 6, 3)] == 1 and got[(2, 2, 1)] == got[(3, 3, 1)] == got[(4, 4, 1)] == 1
    assert got[(None, None, 1)] == 1 and got[(10, 10, 1)] == 2 and len(rows) == odd_docs.count()
    kept = near_duplicates.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter({i: 1 for i in (1, 2, 3, 4, 5, 6, 8, 9, None)} | {10: 2})
    assert near_duplicates.near_duplicate_classes(no_docs).isEmpty() and near_duplicates.keep_one(no_docs).isEmpty()


def test_keep_one_leaves_one_of_each_class(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id bigint, text string")
    classes = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(docs).collect()}
    assert sorted(r["doc_id"] for r in near_duplicates.keep_one(docs).collect()) == sorted(set(classes.values()))


def test_a_text_with_many_copies(spark):
    """Copies are like the base alone, and far more of them share a sketch with it than are its neighbours."""
    rng = random.Random(21)
    base, texts = prose(rng, 200), []
    for _ in range(500):
        words = list(base)
        for i in rng.sample(range(200), 24):
            words[i] = prose(rng, 1)[0]
        texts.append(" ".join(words))
    texts = [" ".join(base), *texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(docs).collect()}
    sketch = [near_duplicates.order_minhash(word_hashes(t)) for t in texts]
    met = [i for i, s in enumerate(sketch) if (s == sketch[0]).any()]
    assert len(met) > 400 and all(got[i] == 0 for i in met)


@pytest.mark.parametrize("edits, size, least", [(0.1, 200, 1.0), (0.15, 200, 0.99), (0.2, 200, 0.97), (0.2, 60, 0.95)])
def test_share_of_pairs_that_meet(edits, size, least):
    rng, met = random.Random(23), 0
    for _ in range(300):
        base = prose(rng, size)
        other = list(base)
        for i in rng.sample(range(size), int(edits * size)):
            other[i] = prose(rng, 1)[0]
        a, b = (near_duplicates.order_minhash(word_hashes(" ".join(x))) for x in (base, other))
        met += bool((a == b).any())
    print(f"met: edits {edits}, {size} words: {met} of 300")
    assert met >= least * 300


def test_short_texts_always_meet(spark):
    rng, texts = random.Random(24), []
    for size in (5, 6, 9, 10, 14, 15, 20, 40):
        base = prose(rng, size)
        most = size // 5
        other = [prose(rng, 1)[0] if i % 5 == min(4, size // 2) and i // 5 < most else w for i, w in enumerate(base)]
        texts += [" ".join(base), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(docs).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_every_pair_of_a_large_bucket(spark):
    """Texts around one passage: each similar pair with an equal sketch is found, wherever others sort."""
    rng = random.Random(22)
    passage, texts = prose(rng, 150), []
    for _ in range(150):
        own = prose(rng, 60)
        texts += [" ".join(passage + own), " ".join(edited(rng, passage[:130], 0.12) + passage[130:] + own)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(docs).collect()}
    hashes = [word_hashes(t) for t in texts]
    sketch = np.array([near_duplicates.order_minhash(h) for h in hashes])
    links = []
    for i in range(len(texts)):
        for j in np.flatnonzero((sketch[i + 1 :] == sketch[i]).any(axis=1)) + i + 1:
            if similar(hashes[i], hashes[j]):
                links.append((i, int(j)))
    assert len(links) > 50
    assert got == closed(range(len(texts)), links)


def test_rows_of_a_large_group_meet_their_key_once(spark):
    """What pivots and blocks need of a key comes with its rows, so neither joins the rows by key again."""
    rows = [(k, n, 4) for k, members in ((1, (10, 11, 12, 13)), (2, (20, 21, 22, 23)), (3, (30, 31, 32, 33))) for n in members]
    rows = spark.createDataFrame([(*r, r[1]) for r in rows], "key bigint, node bigint, size bigint, root bigint")
    labels = spark.createDataFrame([(10, 10), (11, 10), (12, 10), *((n, 20) for n in range(20, 24)), (32, 31), (31, 31)], "node bigint, root bigint")
    links = spark.createDataFrame([(10, 11), (11, 12), (31, 32), (33, 99), (33, 98)], "a bigint, b bigint")
    live = near_duplicates._apart(rows, labels, links)
    got = {(r["key"], r["node"], r["root"], r["pivot"], r["top"], r["major"], r["minors"]) for r in live.collect()}
    # Key 2 is one class; in key 3 the text of most links is outside the largest class.
    first = {(1, n, r, 11, 10, 10, 1) for n, r in ((10, 10), (11, 10), (12, 10), (13, 13))}
    assert got == first | {(3, n, r, 33, 33, 31, 2) for n, r in ((30, 30), (31, 31), (32, 31), (33, 33))}
    for made in (near_duplicates._with_pivots(live), near_duplicates._across(live)):
        assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    met = {(r["node"], r["root"], r["side"]) for r in near_duplicates._with_pivots(live).collect()}
    assert met == {(13, 13, 0), (11, 10, 1), (30, 30, 0), (31, 31, 0), (32, 31, 0), (33, 33, 1)}
    across = {(r["node"], r["root"], r["side"]) for r in near_duplicates._across(live).collect()}
    assert across == {(r[1], r[2], 0) for r in got} | {(13, 13, 1), (30, 30, 1), (33, 33, 1)}


def test_components_of_a_path(spark):
    edges = spark.range(60).selectExpr("id as a", "id + 1 as b").union(spark.sql("select 100L, 101L"))
    got = {r["node"]: r["root"] for r in near_duplicates.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# ---------------------------------------------------------------- lines


def test_patience_is_a_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert line_dedup.patience([1, 2, 3, 9, 4], [1, 2, 7, 3, 4]) == [(0, 0), (1, 1), (2, 3), (4, 4)]


LINES = [
    (1, "alpha one two three four\nbeta one two three four\ngamma x"),
    (2, "own text of the second one\nalpha one two three four\n  beta one two three four \nlast own line of two"),
    (3, "beta one two three four\nalpha one two three four\nnew words in the third text"),
    (4, "gamma x\nsomething else that is new here"),
    (5, "alpha one two three four\nbeta one two three four\ngamma x"),
    (6, "alpha one two three four\nalpha one two three four"),
    (7, "own text of the second one\nown text of the second one\n\nseven has a text"),
]


def test_lines_by_hand(spark):
    docs = spark.createDataFrame(LINES, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["deleted"], r["deleted_words"]) for r in line_dedup.line_report(docs).collect()}
    assert got == {1: ("", 0), 2: ("1,2", 10), 3: ("0,1", 10), 4: ("", 0), 5: ("0,1,2", 12), 6: ("0,1", 10), 7: ("0,1", 12)}
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs).collect()}
    assert set(left) == {1, 2, 3, 4, 7} and left[1] == LINES[0][1] and left[4] == LINES[3][1]
    assert left[2] == "own text of the second one\nlast own line of two" and left[7] == "\nseven has a text"


def test_first_lines_stay_and_copies_go(spark, small):
    docs = small["documents"].select("doc_id", "text")
    texts = dict(docs.collect())
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs).collect()}
    clean = lambda t: [x.strip(" \t\n\x0b\f\r") for x in (t or "").split("\n")]
    first = {}
    for i in sorted(texts):
        for x in clean(texts[i]):
            first.setdefault(x, i)
    for i, t in texts.items():
        kept = Counter(clean(left.get(i, "")))
        for x in clean(t):
            if x and first[x] == i:
                assert kept[x]
            if x and first[x] < i and len(x.split()) >= line_dedup.MIN_WORDS:
                assert not kept[x]


def test_lines_of_odd_texts(odd_docs, no_docs):
    out = line_dedup.drop_lines(odd_docs)
    assert out.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    # Equal rows are one document; the equal text under a later id is a copy and goes.
    assert ids == Counter({i: 1 for i in (1, 2, 3, 4, 5, 8, 9, None)} | {6: 2, 10: 2})
    assert line_dedup.drop_lines(no_docs).isEmpty() and line_dedup.line_report(no_docs).isEmpty()


# ---------------------------------------------------------------- benchmark

ITEM = "a train leaves the old station at 40 km per hour and Maria waits 40 minutes before she takes 12 apples to Peter"


def in_doc(text):
    return "some words come before it and then " + text + " and some words follow after it"


@pytest.fixture(scope="module")
def leaks(spark):
    rows = [
        (1, in_doc(ITEM)),
        (2, in_doc(ITEM.replace("40", "75").replace("12", "8").replace("Maria", "Olga").replace("Peter", "Hans"))),
        (3, in_doc(ITEM.replace("40 km", "60 km"))),  # one value turned into two
        (4, in_doc(ITEM.replace("station", "harbour"))),
        (5, in_doc("a train leaves the old station at noon and nobody waits for it any more at all")),
        (6, in_doc(ITEM.upper())),
        (7, in_doc(" ".join(ITEM.split()[:15]))),
        (8, "tiny item"),
        (9, in_doc(ITEM.replace("km", "miles").replace("minutes", "days"))),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(10, ITEM), (11, "tiny item"), (12, ITEM), (13, None), (14, ""), (None, "an item without any id of its own at all")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_templates_and_slots(leaks, items):
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(leaks, items).collect()}
    # In capitals no word looks like a name, but the windows without names are the same.
    assert set(got) == {(1, 10), (2, 10), (4, 10), (6, 10), (7, 10), (8, 11), (9, 10)}
    assert got[1, 10]["coverage"] == 1.0 and got[1, 10]["exchanged"] == 0
    assert got[2, 10]["coverage"] == 1.0 and got[2, 10]["exchanged"] >= 3
    kept = decontamination.drop_contaminated(leaks, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5] and kept.columns == leaks.columns


def test_wrapped_items(spark, items):
    """An item that is wrapped before each of its names and units, in every way a text can be."""
    docs = [(i, in_doc(re.sub(r" (Maria|Peter|km|minutes)", blank + r"\1", ITEM))) for i, blank in enumerate(["\n", "\t", "  ", "\r\n"])]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: r["coverage"] for r in decontamination.contaminated(docs, items).collect()}
    assert got == {i: 1.0 for i in range(4)}


def test_closing_punctuation_and_one_changed_value(spark):
    tail = "while the small grey cat sleeps on a warm stone wall near the quiet garden gate all day long"
    item = f"we met Maria in the old town and then 40 people saw Maria with 40 red flowers {tail}"
    rows = [
        (1, in_doc(item.replace("saw Maria", "saw Maria,").replace("40 red", "40, red"))),
        (2, in_doc(item.replace("40 red", "55 red"))),  # the windows of the tail are verbatim
        (3, in_doc(item.replace("Maria in", "Maria; in").replace("long", "long."))),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontamination.contaminated(docs, items).collect()}
    assert set(got) == {1, 2, 3} and got[1]["coverage"] == got[3]["coverage"] == 1.0
    assert got[1]["exchanged"] == got[3]["exchanged"] == 0 and 0.5 <= got[2]["coverage"] < 1.0


def test_leaks_equal_brute_force(small):
    docs, bench = small["documents"].select("doc_id", "text"), small["benchmark"]
    got = {r["doc_id"]: r["item_id"] for r in decontamination.contaminated(docs, bench).collect()}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    for r in docs.collect():
        w = words(r["text"])
        mine = [i for i, x in items.items() if any(w[k : k + len(x)] == x for k in range(len(w)))]
        assert ([got[r["doc_id"]]] if r["doc_id"] in got else []) == mine


def test_decontamination_of_odd_texts(odd_docs, no_docs, items, spark):
    assert decontamination.contaminated(odd_docs, items).isEmpty()
    out = decontamination.drop_contaminated(odd_docs, items)
    assert out.count() == odd_docs.count() and out.columns == odd_docs.columns
    assert decontamination.contaminated(no_docs, items).isEmpty()
    assert decontamination.contaminated(odd_docs, items.limit(0)).isEmpty()
    twice = spark.createDataFrame([(None, in_doc(ITEM)), (None, in_doc(ITEM)), (1, None)], "doc_id bigint, text string")
    assert [tuple(r)[:2] for r in decontamination.contaminated(twice, items).select("doc_id", "item_id").collect()] == [(None, 10)]
    assert decontamination.drop_contaminated(twice, items).count() == 1
    plan = decontamination.contaminated(twice, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
