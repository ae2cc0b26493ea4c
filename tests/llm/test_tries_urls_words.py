"""Conversation tries, URL verdicts and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from monsoon.llm import conversation_trie, spelling_index, url_reputation

TURNS = "conv_id bigint, turn bigint, role string, text string, x1 bigint, depth string, part int"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# ---------------------------------------------------------------- conversations


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(int)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(who), len(node), parent, len(who), children[node], leaves[node], saved[node], digest))
    return sorted(out, key=str)


def tried(spark, rows):
    frame = spark.createDataFrame(rows, TURNS).repartition(3)
    return conversation_trie.trie(*conversation_trie.rebuild(frame))


def collected(nodes):
    assert nodes.columns == NODE
    return sorted((tuple(r) for r in nodes.collect()), key=str)


def conversations(seed, count, texts):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-150, 450), count):
        for t in range(draw.randint(1, 9)):
            turn = None if draw.random() < 0.05 else t // 2 if draw.random() < 0.2 else t
            rows.append((c, turn, draw.choice(["user", "assistant", None]), draw.choice(texts), 1, "d", 2))
    return rows


def test_trie_of_odd_conversations(spark, monkeypatch):
    # Small blocks and pieces, so that running sums and lists of ends go over several of them.
    monkeypatch.setattr(conversation_trie, "BLOCK", 3)
    monkeypatch.setattr(conversation_trie, "PIECE", 4)
    rows = conversations(5, 120, ["a", "bb", None, "", "é\U0001f600"])
    rows += [(7, 1, "user", "same", 1, "d", 2)] * 3 + [(None, 0, "user", "nobody", 1, "d", 2)]
    rows += [(300 + c, t, "user", f"turn {t}", 1, "d", 2) for c in range(40) for t in range(4)]
    rows += [(411, t, "user", "long " * 10_000 if t == 8 else "t", 1, "d", 2) for t in range(60)]
    assert collected(tried(spark, rows)) == brute_trie(rows)


def test_one_conversation_over_many_partitions(spark):
    """Most rows are of one conversation, which the range partitioning splits."""
    rows = [(100, t, "user", f"{t}", 1, "d", 2) for t in range(600)] + [(101, 0, "user", "0", 1, "d", 2)]
    got = conversation_trie.positions(spark.createDataFrame(rows, TURNS).repartition(5)).collect()
    assert sorted((r["conv_id"], r["position"], r["text"]) for r in got) == sorted(
        [(100, t, f"{t}") for t in range(600)] + [(101, 0, "0")]
    )
    assert collected(tried(spark, rows)) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert collected(tried(spark, [])) == []
    assert collected(tried(spark, [(None, 0, "user", "x", 1, "d", 2)])) == []


def test_turns_of_nodes(spark):
    rows = [(1, 0, "user", "hello", 1, "d", 2), (1, 1, "assistant", "yes", 1, "d", 2)]
    turns, ids = conversation_trie.rebuild(spark.createDataFrame(rows, TURNS))
    shown = conversation_trie.with_turns(conversation_trie.trie(turns, ids), turns).collect()
    left = brute_trie(rows)[-1][1]
    assert sorted(r["depth"] for r in shown) == list(range(left + 1))
    assert all((r["text"] is None) == (r["depth"] == 0) for r in shown)


# ---------------------------------------------------------------- urls

PAGES = "page_id bigint, url string, host string, bad int, n bigint, bound double"
URLS = [
    ("http://A.Example.NET/en/1?x=/fr/", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/En/1#://q", "example.net", "/En/1", "net/", "block"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://net", "net", "", None, None),
    ("http://b.example.com/de/x", "b.example.com", "/de/x", "example.com/de/", "block"),
    ("http://b.example.com?/de/x", "b.example.com", "", None, None),
    ("http://myexample.com/de/x", "myexample.com", "/de/x", None, None),
    ("ftp://x.org/fr/#a", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://x.org/de/", "x.org", "/de/", None, None),
    ("no scheme/net/", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("http:///fr/", "", "/fr/", None, None),
    ("x://ÀB.NET/é\n://y", "Àb.net", "/é\n://y", "net/", "block"),
    ("http://long.org/" + "a" * 50_000, "long.org", "/" + "a" * 50_000, None, None),
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u[0], "h", 1, 2, 0.5) for i, u in enumerate(URLS)]
    rows.append((0, URLS[0][0], "h", 1, 2, 0.5))
    none = spark.createDataFrame([], "page_id bigint, bad int")
    got = url_reputation.judge(spark.createDataFrame(rows, PAGES), none).collect()
    want = [(i, h, p, r, v or "allow") for i, (_, h, p, r, v) in enumerate(URLS)] + [(0, *URLS[0][1:])]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)


def test_equally_long_rules_go_by_the_alphabet(spark):
    rules = [("b.c", "/", "block"), ("c", "/b/", "allow")]
    page = spark.createDataFrame([(1, "http://b.c/b/")], "page_id bigint, url string")
    none = spark.createDataFrame([], "page_id bigint, bad int")
    assert url_reputation.judge(page, none, rules).first()["rule"] == "b.c/"


def brute_posteriors(hosts):
    """Shrinking by the formulas, level by level, over {host: (labels, bad)}."""

    def strength(groups):
        groups = [g for g in groups if g[0]]
        spread = sum(n * (b / n - p) ** 2 for n, b, p in groups)
        plain, extra = sum(p * (1 - p) for _, _, p in groups), sum(p * (1 - p) * (n - 1) for n, _, p in groups)
        alike = min(max((spread - plain) / extra if extra else 1e-4, 1e-4), 0.999)
        return (1 - alike) / alike

    def summed(of):
        out = defaultdict(lambda: [0, 0])
        for host, (n, b) in hosts.items():
            out[of(host)][0] += n
            out[of(host)][1] += b
        return out

    suffix, domain = (lambda h: h.split(".")[-1]), (lambda h: ".".join(h.split(".")[-2:]))
    total = summed(lambda h: 0)[0]
    prior = {s: (total[1] + 1) / (total[0] + 2) for s in summed(suffix)}
    for of, above in ((suffix, suffix), (domain, suffix)):
        groups = summed(of)
        up = {g: prior[g if of is above else above(g)] for g in groups}
        m = strength([(n, b, up[g]) for g, (n, b) in groups.items()])
        prior = {g: (b + m * up[g]) / (n + m) for g, (n, b) in groups.items()}
    m = strength([(n, b, prior[domain(h)]) for h, (n, b) in hosts.items()])
    out = {}
    for h, (n, b) in hosts.items():
        x, y = b + m * prior[domain(h)], n - b + m * (1 - prior[domain(h)])
        out[h] = x / (x + y) - 1.645 * (x * y / ((x + y) ** 2 * (x + y + 1))) ** 0.5
    return out


def test_posterior_bounds(spark):
    draw = random.Random(3)
    counts, pages, outcomes = {}, [], []
    rates = {"spam.bad.com": 0.97, "few.bad.com": 1.0, "good.bad.com": 0.05, "big.fine.org": 0.1, "one.fine.org": 1.0, "q.io": 0.5}
    for host, size in zip(rates, (80, 4, 60, 300, 1, 12)):
        bad = round(rates[host] * size)
        counts[host] = (size, bad)
        for i in range(size + draw.randint(0, 3)):
            page = len(pages)
            pages.append((page, f"http://{host}/en/{page}", "h", 1, 2, 0.5))
            if i < size:
                outcomes.append((page, int(i < bad)))
    counts["never.fine.org"] = (0, 0)
    pages.append((len(pages), "http://never.fine.org/", "h", 1, 2, 0.5))
    outcomes += [(len(pages) - 1, None), (None, 1)]
    got = url_reputation.judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(outcomes, "page_id bigint, bad int"))
    want = brute_posteriors(counts)
    rows = got.collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["host_labels"], r["host_bad"]) == counts[r["host"]]
        assert r["bound"] == pytest.approx(want[r["host"]], abs=1e-9)
        assert r["verdict"] == ("block" if want[r["host"]] > 0.5 else "allow")
    verdicts = {r["host"]: r["verdict"] for r in rows}
    # Many bad pages are enough, a single bad one in a good domain isn't.
    assert verdicts["spam.bad.com"] == "block" and verdicts["one.fine.org"] == verdicts["good.bad.com"] == "allow"


def test_no_pages(spark):
    none = spark.createDataFrame([], PAGES)
    assert url_reputation.judge(none, none.select("page_id", "bad")).collect() == []


# ---------------------------------------------------------------- words


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def brute_variants(counts):
    form, out = {}, {}
    for w, n in counts.items():
        others = [u for u in counts if near(w, u)]
        best = min(others, key=lambda u: (-counts[u], u), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
        out[w] = len(others)
    rows = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, out[w], counts.get(form[w])))
    return sorted(rows, key=str)


def variants(spark, counts, shard):
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    return sorted((tuple(r) for r in spelling_index.variants(words, shard).collect()), key=str)


@pytest.mark.parametrize("shard", [7, 16_000])
def test_variants_of_close_words(spark, shard):
    """Words over few letters, so that most have many near words; small shards split the groups into blocks."""
    draw = random.Random(11)
    words = {"".join(draw.choices("abé", k=draw.randint(7, 9))) for _ in range(250)}
    words |= {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÿ" * 8, "ÿ" * 7 + "a", "x" * 20_000, "x" * 20_001}
    counts = {w: draw.choice([2, 2, 3, 20, 25, 200, 250, 3000]) for w in sorted(words)}
    assert variants(spark, counts, shard) == brute_variants(counts)


def test_chains_and_ties_of_forms(spark):
    counts = {"letterxx": 2, "letterx": 20, "letters": 200, "letter": 0, "letterss": 200, "otherword": 5}
    counts = {w: n for w, n in counts.items() if n}
    got = {r[0]: r for r in variants(spark, counts, 16_000)}
    assert got["letterxx"][1:3] == ("letterx", "letters")
    assert got["letterx"][1:3] == ("letters", "letters")
    tied = {"xletters": 20, "yletters": 20, "letters": 2}
    assert {r[0]: r[1] for r in variants(spark, tied, 16_000)}["letters"] == "xletters"
    chain = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000}
    assert {r[0]: r[2] for r in variants(spark, chain, 16_000)} == dict.fromkeys(chain, "abcdefghij")


def test_index_steps_count_occurrences():
    words = ["banana", "bandana", "nab", "a"]
    codes, sizes = spelling_index._coded(words)
    index = spelling_index.Index(codes, sizes)
    letters = {c: i + 1 for i, c in enumerate(sorted(set("".join(words))))}
    text = "|" + "|".join(words) + "|"
    for piece in ("an", "ana", "|ban", "na|", "dd", "b", "|a|"):
        low, high = np.zeros(1, np.int64), np.full(1, index.size)
        for c in piece:
            low, high = index.step(np.array([letters.get(c, 0)]), low, high)
        count = sum(text.startswith(piece, i) for i in range(len(text)))
        assert int(high[0] - low[0]) == count


def test_vocabulary(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()] + [(77, "Éclairs éclairs ÉCLAIRS wordsÿword×s")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = defaultdict(int)
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                word = run.translate(lower)
                h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
                if h % 31 == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                counts[word] += len(word) >= 7
            run = ""
    got = {r["word"]: r["n"] for r in spelling_index.vocabulary(docs).collect()}
    assert got == {w: n for w, n in counts.items() if n >= 2}
    assert spelling_index.variants(spelling_index.vocabulary(no_docs)).collect() == []
