"""License scans with a positional index of rare words.

Each template is a sequence of words with mandatory key phrases. Its words of highest inverse document frequency, counted
over the whole corpus, are its index words; a posting is (template, position). Where a text has an index word, the
postings give the places at which the template would start; the words there are compared by relative position, weighed
by their frequency, and the mandatory phrases are verified word by word. Phrases that must be found at every place
are templates that are mandatory as a whole.

Texts are handled as bytes: one translation table lower-cases A-Z and blanks out separators, so a word is a run of
0-9, a-z and bytes from 0x80 on. Only the words in the index are looked at one by one.

Defined results: a null or empty text has no words, no places, no labels and the score 0; equal rows get equal results;
an empty corpus has no frequencies, and every word then weighs the same. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))

#: Phrases counted at every place, and the label of each. Fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices, their labels and their mandatory key phrases. Fixed values.
NOTICES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ("source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)


def text_words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    mandatory: tuple[tuple[int, int], ...]  # ranges of positions
    base: bool


def _position(words: list[bytes], phrase: list[bytes]) -> tuple[int, int]:
    at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    return at, at + len(phrase)


def templates(notices=NOTICES, base=BASE) -> list[Template]:
    made = [Template(label, tuple(w := p.encode().split()), ((0, len(w)),), True) for p, label in base.items()]
    for label, text, phrases in notices:
        w = text.encode().split()
        made.append(Template(label, tuple(w), tuple(_position(w, p.encode().split()) for p in phrases), False))
    return made


class Index:
    """Postings of the rarest words of each template."""

    def __init__(self, made: list[Template], documents: int, frequency: dict[bytes, int], per_template: int = 2):
        self.templates = made
        vocabulary = {w for t in made for w in t.words}
        self.idf = {w: 1.0 + math.log((documents + 1) / (frequency.get(w, 0) + 1)) for w in vocabulary}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for n, t in enumerate(made):
            # A mandatory word, or a text that has the phrase alone could be missed.
            must = {i for a, b in t.mandatory for i in range(a, b)}
            rare = sorted(must, key=lambda i: (-self.idf[t.words[i]], i))[: 1 if t.base else per_template]
            for i in rare:
                self.postings[t.words[i]].append((n, i))
        self.totals = [sum(self.idf[w] for w in t.words) for t in made]

    def scan(self, words: list[bytes], least: float = 0.5) -> list[tuple[int, int, float]]:
        """(template, start, score) of every place; the start of a notice can lie before the text's first word."""
        if self.postings.keys().isdisjoint(words):
            return []
        starts = {(n, p - i) for p, w in enumerate(words) if w in self.postings for n, i in self.postings[w]}
        found = []
        for n, start in sorted(starts):
            t = self.templates[n]
            if all(start + a >= 0 and tuple(words[start + a : start + b]) == t.words[a:b] for a, b in t.mandatory):
                inside = range(max(0, -start), min(len(t.words), len(words) - start))
                score = sum(self.idf[t.words[i]] for i in inside if words[start + i] == t.words[i]) / self.totals[n]
                if score >= least or t.base:
                    found.append((n, start, min(1.0, score)))
        return found


def frequencies(docs: DataFrame, made: list[Template]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those with each word of the templates, over the whole corpus."""
    vocabulary = frozenset(w for t in made for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                seen[b""] += 1
                seen.update(vocabulary.intersection(text_words(text or b"")))
        yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.binary()), pa.array([*seen.values()], pa.int64())], ["w", "n"])

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "w binary, n bigint")
    # One row per word of the templates: bounded by them, not by the corpus.
    rows = {bytes(r["w"]): r["n"] for r in counted.groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return rows.pop(b"", 0), rows


RESULT = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, places string"
)


def scan(docs: DataFrame, made: list[Template] | None = None) -> DataFrame:
    """Per document: counts, labels, score, and ``places`` as label@word, space-joined, of all that was found."""
    made = made or templates()
    index = Index(made, *frequencies(docs, made))
    schema = pa.schema(
        [("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
        + [(c, pa.string()) for c in ("base_labels", "labels")] + [("score", pa.float64()), ("places", pa.string())]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                words = text_words(text or b"")
                found = index.scan(words)
                base = [(index.templates[n].label, at) for n, at, _ in found if index.templates[n].base]
                starts = [at for _, at in base]
                out.append(
                    (doc, len(words), len(base), min(starts, default=None), max(starts, default=None),
                     ",".join(sorted({x for x, _ in base})), ",".join(sorted({index.templates[n].label for n, _, _ in found})),
                     max((s for _, _, s in found), default=0.0), " ".join(f"{index.templates[n].label}@{at}" for n, at, _ in found))
                )
            columns = list(zip(*out)) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(find, RESULT)
