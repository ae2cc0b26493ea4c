"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased terms and of their first four and five letters (the stems of inflected words),
hashed into buckets. The score is the logistic function of a bias, a weight
per term and the inner products of the factors of every two terms, so that two terms which are harmless alone can count
together. The pairwise sum costs one pass: half of (the square of the sum of factors less the sum of their squares).

The model is fitted on a bounded sample of labelled rows (``max_rows``, a parameter) gathered on the driver as bucket
numbers; scoring is Arrow-batched over whole texts with the fitted weights broadcast: 2^18 buckets and 4 factors are
about 5 MB whatever the corpus. Only terms whose share of toxic texts differs clearly from that of all texts (a likelihood
ratio test, ``least_ratio``) get a weight and factors, so that the words of long texts don't add up to noise; and so do both
terms of a pair that is toxic more or less often than a machine of the former expects (``telling_pairs``), each of which
may be as frequent in clean as in toxic texts. Pairs are looked for among the ``pair_terms`` most frequent terms of the sample.

Defined results: null and empty texts get the score of the bias alone; a null doc_id is scored and never learnt from;
several labels of one document count as toxic if one of them does; equal rows get equal scores; without a toxic label
every score is near 0. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM = re.compile(r"[^\W\d_]+")
BITS = 18
STEMS = (4, 5)
CACHE = 200_000


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray  # one per bucket
    factors: np.ndarray  # buckets x k

    def score(self, buckets: list[np.ndarray]) -> np.ndarray:
        """Scores of texts given as arrays of distinct buckets."""
        sizes = np.fromiter((len(b) for b in buckets), np.int64, len(buckets))
        raw = np.full(len(buckets), self.bias)
        if sizes.sum():
            flat, full = np.concatenate(buckets), sizes > 0
            at = (np.cumsum(sizes) - sizes)[full]
            v = self.factors[flat]
            both = np.add.reduceat(v, at, axis=0) ** 2 - np.add.reduceat(v**2, at, axis=0)
            raw[full] += np.add.reduceat(self.weights[flat], at) + 0.5 * both.sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30)))


class Hasher:
    """Distinct buckets of a text; recent words keep their bucket in a table of bounded size."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known = (1 << bits) - 1, {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, found = self.known, set()
        for term in set(TERM.findall((text or "").lower())):
            own = known.get(term)
            if own is None:
                if len(known) >= CACHE:
                    known.clear()
                forms = [term, *(f"^{term[:n]}" for n in STEMS if len(term) > n)]
                own = known[term] = tuple(zlib.crc32(f.encode("utf-8", "replace")) & self.mask for f in forms)
            found.update(own)
        return np.fromiter(sorted(found), np.int64, len(found))


def likelihood_ratio(hits: np.ndarray, counts: np.ndarray, share: float) -> np.ndarray:
    """Twice the log of how much likelier ``hits`` of ``counts`` are at their own share than at ``share``."""
    out = np.zeros(len(counts))
    for seen, expected in ((hits, counts * share), (counts - hits, counts * (1 - share))):
        at = seen > 0
        out[at] += 2 * seen[at] * np.log(seen[at] / expected[at])
    return out


def telling_pairs(
    rows: list[np.ndarray], toxic: np.ndarray, expected: np.ndarray, terms: np.ndarray, size: int, least_ratio: float
) -> np.ndarray:
    """The terms of all pairs that stand in toxic texts more or less often than ``expected`` says, by a score test.

    The threshold grows with the number of pairs as their best chance finding does. Texts are taken some at a time, so what is
    held are two squares of the terms.
    """
    place = np.full(size, -1)
    place[terms] = np.arange(len(terms))
    excess, variance = (np.zeros((len(terms), len(terms)), np.float32) for _ in range(2))
    spread = np.clip(expected, 0.05, 0.95)
    for begin in range(0, len(rows), 512):
        part = slice(begin, begin + 512)
        has = np.zeros((len(rows[part]), len(terms)), np.float32)
        for i, r in enumerate(rows[part]):
            own = place[r]
            has[i, own[own >= 0]] = 1
        excess += has.T @ (has * (toxic[part] - expected[part]).astype(np.float32)[:, None])
        variance += has.T @ (has * (spread[part] * (1 - spread[part])).astype(np.float32)[:, None])
    least = least_ratio + 2 * np.log(max(1, len(terms) * (len(terms) - 1) // 2))
    telling = excess**2 > least * np.maximum(variance, 0.25)
    np.fill_diagonal(telling, False)
    return terms[telling.any(axis=0)]


def fit(
    rows: list[np.ndarray],
    toxic: np.ndarray,
    min_docs: int = 3,
    least_ratio: float = 15.0,
    pair_terms: int = 2_000,
    bits: int = BITS,
    **settings,
) -> Machine:
    """A machine of the terms that tell alone and of those that tell in pairs; ``settings`` are those of the descent."""
    size = 1 << bits
    toxic = np.asarray(toxic, float)
    if not toxic.sum():
        return Machine(-10.0, np.zeros(size, np.float32), np.zeros((size, settings.get("factors", 4)), np.float32))
    counts, hits = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for begin in range(0, len(rows), 512):  # some rows at a time: the sample is held once
        part = rows[begin : begin + 512]
        counts += np.bincount(np.concatenate(part), minlength=size)
        own = [r for r, t in zip(part, toxic[begin : begin + 512]) if t]
        if own:
            hits += np.bincount(np.concatenate(own), minlength=size)
    alone = (counts >= min_docs) & (likelihood_ratio(hits, counts, toxic.mean()) >= least_ratio)
    machine = _descend(rows, toxic, np.flatnonzero(alone), size, **settings)
    frequent = np.argsort(-counts, kind="stable")[:pair_terms]
    frequent = np.sort(frequent[counts[frequent] >= min_docs])
    expected = np.concatenate([machine.score(rows[i : i + 64]) for i in range(0, len(rows), 64)])
    paired = telling_pairs(rows, toxic, expected, frequent, size, least_ratio)
    if alone[paired].all():
        return machine
    alone[paired] = True
    return _descend(rows, toxic, np.flatnonzero(alone), size, **settings)


def _descend(
    rows: list[np.ndarray],
    toxic: np.ndarray,
    kept: np.ndarray,
    size: int,
    factors: int = 4,
    epochs: int = 30,
    batch: int = 64,
    rate: float = 0.2,
    l1: float = 1e-4,
    l2: float = 1e-3,
    seed: int = 3,
) -> Machine:
    """Mini-batch Adagrad on the logistic loss, weights with an L1 penalty, factors with an L2 penalty."""
    weights, vectors = np.zeros(size, np.float32), np.zeros((size, factors), np.float32)
    rng = np.random.default_rng(seed)
    place = np.full(size, -1)
    place[kept] = np.arange(len(kept))
    rows = [(p := place[r])[p >= 0] for r in rows]
    w, v = np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), factors))
    gw, gv, gb = np.full(len(kept), 1e-2), np.full((len(kept), factors), 1e-2), 1e-2
    share = min(0.95, toxic.mean())
    bias = float(np.log(share / (1 - share)))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            own = [rows[i] for i in chosen]
            sizes = np.array([len(r) for r in own])
            if not sizes.sum():
                continue
            flat = np.concatenate(own)
            doc = np.repeat(np.arange(len(own)), sizes)
            x = v[flat]
            sums = np.zeros((len(own), factors))
            for f in range(factors):
                sums[:, f] = np.bincount(doc, x[:, f], len(own))
            squares = np.bincount(doc, (x**2).sum(axis=1), len(own))
            raw = bias + np.bincount(doc, w[flat], len(own)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - toxic[chosen]
            error /= len(own)
            used, inverse = np.unique(flat, return_inverse=True)
            step = np.bincount(inverse, error[doc], len(used))
            gw[used] += step**2
            pace = rate / np.sqrt(gw[used])
            moved = w[used] - pace * step
            w[used] = np.sign(moved) * np.maximum(0, np.abs(moved) - pace * l1)
            for f in range(factors):
                step = np.bincount(inverse, error[doc] * (sums[doc, f] - x[:, f]), len(used)) + l2 * v[used, f]
                gv[used, f] += step**2
                v[used, f] -= rate / np.sqrt(gv[used, f]) * step
            step = error.sum()
            gb += step**2
            bias -= rate / np.sqrt(gb) * step
    weights[kept], vectors[kept] = w, v
    return Machine(float(bias), weights, vectors)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for b in batches:
        found = [hasher(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.list_(pa.int32())), b.column("toxic")], names=["buckets", "toxic"]
        )


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, seed: int = 3, **settings) -> Machine:
    """Fit on at most about ``max_rows`` labelled documents that aren't held out, chosen by a hash of their id."""
    own = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    total = own.count()
    if total > max_rows:
        own = own.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    # The sample has a bounded number of rows, so it may be broadcast; the texts stay where they are.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id")
    found = rows.select("text", "toxic").mapInArrow(_bucket_batches, "buckets array<int>, toxic int").toArrow()
    buckets = found.column("buckets").combine_chunks()
    values = buckets.flatten().to_numpy() if len(found) else np.zeros(0, np.int32)
    sizes = np.diff(buckets.offsets.to_numpy()) if len(found) else []
    rows = np.split(values, np.cumsum(sizes)[:-1]) if len(found) else []
    toxic = found.column("toxic").to_numpy() if len(found) else np.zeros(0)
    # Rows arrive in no set order; an order by content makes the fit the same in every run.
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), zlib.crc32(rows[i].tobytes()), toxic[i]))
    return fit([rows[i] for i in order], toxic[order] if len(order) else toxic, seed=seed, **settings)


def scorer(docs: DataFrame, machine: Machine):
    """A function from a text column to its score."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher()
        for texts in batches:
            out = np.empty(len(texts))
            values = texts.tolist()
            for begin in range(0, len(values), 64):  # a few texts at a time bound the factors held at once
                part = values[begin : begin + 64]
                out[begin : begin + 64] = model.value.score([hasher(t) for t in part])
            yield pd.Series(out)

    return score


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    score = scorer(docs, machine)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, scorer(docs, machine)("text")).filter(F.col(name) < 0.5).drop(name)
