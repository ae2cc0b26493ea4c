"""Chat logs, token files, secrets, mixes and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from monsoon.llm import chat, mixing, queries, secret_scan, token_files

SF = "/root/testdata/sf0.001"
EVENTS = "conv_id bigint, message bigint, seq bigint, kind string, role string, text string, extra string"


# ---------------------------------------------------------------- chat


def test_fold_of_events(spark):
    rows = [
        (1, 1, 0, "start", "user", "Hel", ""), (1, 1, 2, "delta", None, "!", ""), (1, 1, 1, "delta", None, "lo", ""),
        (1, 2, 3, "start", "assistant", "", ""), (1, 2, 4, "delta", None, "wrong", ""), (1, 2, 5, "regenerate", None, None, ""),
        (1, 2, 6, "delta", None, "ri", ""), (1, 2, 7, "delta", None, "ght", ""),
        (1, 3, 8, "start", "user", "first", ""), (1, 3, 9, "edit", None, "second", ""), (1, 3, 10, "delta", None, None, ""),
        (1, 4, 11, "start", "user", "gone", ""), (1, 4, 12, "delete", None, None, ""), (1, 5, 13, "noise", "user", "?", ""),
        (None, 1, 0, "start", None, None, ""),
    ]
    random.Random(2).shuffle(rows)
    got = chat.fold(spark.createDataFrame(rows, EVENTS).repartition(4)).collect()
    assert sorted(((r["conv_id"], r["position"], r["role"], r["text"]) for r in got), key=str) == sorted(
        [(1, 0, "user", "Hello!"), (1, 3, "assistant", "right"), (1, 8, "user", "second"), (None, 0, "", "")], key=str
    )


@given(st.lists(st.tuples(st.text(alphabet="ab<|\\n\n>é\U0001f600"), st.text(alphabet="<|im_endstar>\\ \n")), max_size=4))
def test_escape_is_reversible(turns):
    esc = lambda t: t.replace("\\", "\\\\").replace("<|", "<\\|")
    for role, text in turns:
        made = f"{chat.START}{esc(role).replace(chr(10), chr(92) + 'n')}\n{esc(text)}{chat.END}\n"
        assert chat.parse(made) == (role, text)
        assert made.count("<|") == 2


def test_chat_digests(spark, small):
    rows = [
        (7, 0, "user", "hi \\ <| x"), (7, 1, "assistant", chat.END + "\n\\n"), (7, 1, "assistant", None), (8, 0, None, "t" * 1000),
        (8, 0, "sys\ntem", "é\U0001f600"), (None, 3, "assistant", ""), (9, 5, "assistant", "b"), (9, 5, "assistant", "b"),
        (9, None, "user", "no turn"),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = turns.unionByName(small["conversations"].select(turns.columns)).repartition(3)
    got = {r["conv_id"]: r for r in chat.digests(chat.render(chat.fold(chat.as_events(turns, chunk=7)))).collect()}
    by = defaultdict(list)
    for r in turns.collect():
        by[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    assert got.keys() == by.keys()
    for conv, own in by.items():
        own.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in own)
        loss = "".join(text for *_, role, text in own if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.render(chat.fold(chat.as_events(turns.limit(0))))).isEmpty()


def test_chat_query_has_the_forged_turns(spark):
    r = queries.op9_chat_events(spark, SF).filter("conv_id = -1").first()
    text = queries.FORGED
    assert (r["n_turns"], r["loss_chars"]) == (2, len(text))
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# ---------------------------------------------------------------- token files


def test_pieces_equal_a_plain_split():
    rng = random.Random(5)
    for _ in range(200):
        ids = np.array([rng.choice([1, 2, 9]) for _ in range(rng.randint(1, 40))])
        size = rng.randint(1, len(ids))
        lengths, _ = token_files.pieces(ids, size, 9, True, 0)
        text = "".join("|" if i == 9 else "x" for i in ids[:size])
        assert lengths == [len(p) for p in text.split("|")]


def test_header_round_trip():
    for doc_id in (None, 0, 1, -1, 49_999, 50_000, 2**63 - 1, -(2**63)):
        assert token_files.doc_id_of(np.array(token_files.header(doc_id))) == doc_id


@pytest.mark.parametrize("block", [64, 1000, 8 << 20])
def test_token_counts(odd_docs, block):
    import public_tokenizers as public

    path = public.path("byte_bpe_50k.tiktoken")
    got = token_files.token_counts(odd_docs, path, public.PATTERN, block=block)
    with open(path, "rb") as f:
        encoding = token_files._encoding(f.read(), public.PATTERN)
    want = Counter((r["doc_id"], len(encoding.encode_ordinary(r["text"] or ""))) for r in odd_docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want


def test_scan_of_plain_files(spark, tmp_path):
    """Files of other makers: no headers, an empty document, no separator at the end, an odd byte."""
    ids = [5, 6, 7, 50304, 50304, 8, 50304, 9, 10]
    (tmp_path / "a.bin").write_bytes(np.array(ids, token_files.ID).tobytes() + b"\x01")
    (tmp_path / "b.bin").write_bytes(np.array([50304], token_files.ID).tobytes())
    (tmp_path / "c.bin").write_bytes(b"")
    for block in (2, 4, 100):
        got = token_files.scan_files(spark, str(tmp_path), head=0, block=block).collect()
        assert sorted((r["file"][-5:], r["number"], r["n_tokens"]) for r in got) == [
            ("a.bin", 0, 3), ("a.bin", 1, 0), ("a.bin", 2, 1), ("a.bin", 3, 2), ("b.bin", 0, 0),
        ]


def test_token_counts_of_nothing(no_docs):
    import public_tokenizers as public

    assert token_files.token_counts(no_docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN).isEmpty()


# ---------------------------------------------------------------- secrets


def test_secrets(spark, no_docs, odd_docs):
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    words = lambda n: " ".join(rng.choice(["the", "river", "station", "before", "walking"]) for _ in range(n))
    rows = []
    for i in range(240):
        what, is_secret = [
            (f'token = "{hexes(40)}"', True), (f"password={hexes(18)}", True),
            ("AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), True),
            ("".join(str(rng.randint(0, 9)) for _ in range(16)), False), (f"river.{i}@mail.example.com", False),
            ("stationwalkingbeforeriver", False), (f"10.20.30.{i:03d}.5", False),
        ][i % 7]
        rows.append((i, f"{words(6)} {what} {words(6)}", "s", is_secret))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, truth boolean")
    extra = [(1000, f"{words(4)} {hexes(40)} {words(4)}", "s", True), (1001, None, None, False), (1002, "", "s", False)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    got = secret_scan.scan(docs).join(docs, "doc_id")
    assert got.filter("secret <> truth").isEmpty()
    assert got.count() == 241
    assert secret_scan.scan(no_docs).isEmpty()
    # Findings of one kind only: no forest, and all of them stay.
    assert secret_scan.scan(odd_docs).filter("score <> 0.5 or not secret").isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


#: Text, and the candidates in it: (part of its word, value, before, assigned).
PLACES = [
    ('{"key":"AKIA%s","region":"eu-west-1"}', [(0, "AKIA%s", "key", True)]),
    ("https://h/?key=AKIA%s&lang=en", [(0, "AKIA%s", "key", True)]),
    ("use `AKIA%s` here", [(0, "AKIA%s", "use", False)]),
    ("host=h;secret=%s;user=u", [(0, "%s", "secret", True)]),
    ("(%s),[AKIA%s]", [(0, "%s", "", False), (1, "AKIA%s", "", False)]),
    ("password=hunter2", [(0, "hunter2", "password", True)]),
    ("password: hunter2", [(0, "hunter2", "password", True)]),
    ("db_password := hunter2", [(0, "hunter2", "db_password", True)]),
    ("my/token=QUJDREVG==", [(0, "QUJDREVG==", "mytoken", True)]),
    ('\\"api-key\\":\\"a1b2c3\\"', [(0, "a1b2c3", "apikey", True)]),
    ("the hunter2 colour=yellow1 secret=x passwords stationwalking", []),
    ("%s" * 40, [(0, "%s" * 40, "", False)]),
    ("漢%s字", [(0, "%s", "", False)]),
]


def test_secret_candidates(spark, odd_docs):
    """All runs of the alphabet of keys, wherever they stand in a word."""
    body = "Q7ZK2M4NX5RTW6PB"
    fill = lambda t: t.replace("%s", body)
    docs = spark.createDataFrame([(i, fill(t), "s") for i, (t, _) in enumerate(PLACES)], "doc_id bigint, text string, source string")
    got = defaultdict(list)
    for r in secret_scan.candidates(docs).orderBy("doc_id", "at", "part").collect():
        got[r["doc_id"]].append((r["part"], r["value"], r["before"], r["assigned"]))
    for i, (_, want) in enumerate(PLACES):
        assert got[i] == [(p, fill(v), b, a) for p, v, b, a in want], PLACES[i]
    assert {r["doc_id"] for r in secret_scan.candidates(odd_docs).collect()} == {9}


def test_planted_secrets(spark):
    """Keys planted in JSON, URLs, backticks and assignments among look-alikes, part of them in forms that are never labelled."""
    rng = random.Random(8)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexes, upper = "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZ234567"
    words = lambda n: " ".join(rng.choice(["the", "river", "station", "before", "walking"]) for _ in range(n))
    rows = []
    for i in range(600):
        what, is_secret = [
            ('{"key":"AKIA%s","region":"eu-west-1"}' % pick(upper, 16), True), ("https://h/?key=AKIA%s&lang=en" % pick(upper, 16), True),
            ("`AKIA%s`" % pick(upper, 16), True), (f"host=h;password=x{pick(hexes, 7)}9;user=u", True), (f"token = {pick(hexes, 32)}", True),
            (pick(hexes, 40), True), (pick("0123456789", 16), False), (f"river.{i}@mail.example.com", False), ("secret=stationriver", False),
            (f"10.20.30.{i:03d}.5", False), ("stationwalkingbeforeriver", False), ("password:walking", False),
        ][i % 12]
        rows.append((i, f"{words(6)} {what} {words(6)}", "s", is_secret))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, truth boolean")
    found = {r["doc_id"] for r in secret_scan.scan(docs).filter("secret").collect()}
    truth = {r[0] for r in rows if r[3]}
    assert len(found & truth) == len(truth) and len(found - truth) == 0


def test_parts_of_values_are_not_broadcast(spark, tmp_path):
    """Few and small values on disk, many parts: their join with the dictionary gathers neither side in the driver."""
    values = [("stationX9river",), ("StationRiver",), ("0123456789abcdef",), (None,), ("rivers" * 200,)]
    spark.createDataFrame(values * 2, "value string").write.parquet(f"{tmp_path}/found")
    spark.createDataFrame([("station",), ("river",)], "word string").write.parquet(f"{tmp_path}/known")
    covered = secret_scan._coverage(spark.read.parquet(f"{tmp_path}/found"), spark.read.parquet(f"{tmp_path}/known"))
    ids = {r["id"]: r["value"] for r in spark.createDataFrame(values, "value string").select("value", F.xxhash64("value").alias("id")).collect()}
    assert {ids[r["id"]][:12]: r["dictionary"] for r in covered.collect()} == {"stationX9riv": 12 / 14, "StationRiver": 1.0, "riversrivers": 5 / 6}
    plan = covered._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


# ---------------------------------------------------------------- mixes


def wanted(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    total = share * sum(sizes.values())
    while open_:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("shard_words", [1_000_000, 5_000])
def test_mix(small, odd_docs, shard_words):
    docs = small["documents"].select("doc_id", "text", "source").unionByName(odd_docs.select("doc_id", "text", "source"))
    rows = mixing.mix(docs, shard_words=shard_words).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    given_ = Counter((r["doc_id"], r["source"], count(r["text"])) for r in docs.collect())
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == given_
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    target = wanted(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    for s in sizes:
        shards = len({r["shard"] for r in rows if r["source"] == s})
        assert abs(taken[s] - target[s]) <= 32 * (2 + shards)
    again = mixing.mix(docs.repartition(5, F.rand(3)), shard_words=shard_words).collect()
    pick = lambda rows: Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in rows)
    assert pick(again) == pick(rows)


def test_quotas_are_sainte_lague(spark):
    """The quotas of a source's shards are those of the highest quotients."""
    sizes = [1000, 777, 500, 333, 120, 64, 33]
    seats = int(0.9 * sum(sizes) / 32 + 0.5)
    rows = [("s", i, n, sum(sizes), 0.9 * sum(sizes), seats) for i, n in enumerate(sizes)]
    shards = spark.createDataFrame(rows, "source string, shard bigint, shard_size bigint, source_size bigint, target double, seats bigint")
    got = {r["shard"]: r["quota"] for r in mixing._quotas(shards, 32, 2.0).collect()}
    assert seats == sum(got.values())
    quotients = sorted(((n / (2 * k + 1), i) for i, n in enumerate(sizes) for k in range(100)), reverse=True)[:seats]
    assert got == Counter(i for _, i in quotients) | {i: 0 for i in got if i not in {j for _, j in quotients}}


@pytest.mark.parametrize(
    "targets",
    [
        [1000.4 * 32, 0.4 * 32, 0.4 * 32, 0.4 * 32], [40.0, 41.0, 42.0, 43.0, 44.0], [16.0] * 9, [1.0] * 40, [0.0, 0.0], [0.0, 100.0],
        [31.9 + 7.3 * (i * i % 83) for i in range(300)], [2.0 * n for n in (33, 64, 5, 1, 700, 10_001)],
    ],
)
def test_seats_are_sainte_lague(spark, targets):
    """The blocks of a source are those of the highest quotients, sources of a few blocks and equal ones included."""
    rows = [(f"{i:03d}", int(t / 2) + 1, t) for i, t in enumerate(targets)]
    made = mixing.seats(spark.createDataFrame(rows, "source string, source_size bigint, target double"), 32, 2.0)
    got = {r["source"]: r["seats"] for r in made.collect()}
    want, open_ = dict.fromkeys(got, 0), {s: 2 * -(-n // 32) for s, n, _ in rows}
    for _ in range(int(sum(targets) / 32 + 0.5)):
        best = min((s for s, _, _ in rows if want[s] < open_[s]), key=lambda s: (-targets[int(s)] / (2 * want[s] + 1), s))
        want[best] += 1
    assert got == want


def test_mix_of_nothing(no_docs, odd_docs):
    assert mixing.mix(no_docs).isEmpty()
    blank = mixing.mix(odd_docs.filter("doc_id in (2, 3, 4)")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 3


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    item, passage, base = prose(30), prose(60), prose(120)
    rows = [(i, prose(80), "s1" if i % 2 else "s2") for i in range(60)]
    rows += [(100 + i, f"{prose(20)} idiot {prose(20)}", "s1") for i in range(40)]
    rows += [(200, f"{prose(40)} {item} {prose(40)}", "s2"), (201, prose(30) + "\n" + passage, "s2")]
    rows += [(202, passage + "\n" + prose(30), "s2"), (203, base, "s1"), (204, base.replace(base[:6], "zzzzzz", 1), "s1"), (205, base, "s1")]
    rows += [(300, None, "s3"), (301, "", None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i >= 100)) for i, *_ in rows if i < 140]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    kept, step = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, str(tmp_path)).collect(), docs.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in step.collect()}
    clean = {i for i, *_ in rows if i < 100}
    assert set(kept["toxicity"]) == clean | {200, 201, 202, 203, 204, 205, 300, 301}
    assert set(kept["line_dedup"]) == set(kept["toxicity"]) - {205}  # an exact copy loses every line
    assert passage in kept["line_dedup"][201] and passage not in kept["line_dedup"][202]
    assert set(kept["near_duplicates"]) == set(kept["line_dedup"]) - {204}
    assert set(kept["decontamination"]) == clean | {201, 202, 203, 300, 301}
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in mixed} == set(kept["decontamination"])
    assert {r["doc_id"]: r["size"] for r in mixed} == {i: len((t or "").split()) for i, t in kept["decontamination"].items()}
    plain = mixing.mix(step).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in plain) == Counter((r["doc_id"], r["taken"]) for r in mixed)


def test_pipeline_of_odd_texts(spark, tmp_path, odd_docs, no_docs, small):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        at = tmp_path / name
        docs.write.parquet(str(at / "documents.parquet"))
        small["labels"].write.parquet(str(at / "labels.parquet"))
        small["benchmark"].write.parquet(str(at / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).isEmpty()
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect())
    assert got == Counter({i: 1 for i in (1, 2, 3, 4, 5, 6, 8, 9, None)} | {10: 2})
