"""Secret scans: candidates by shape, false positives removed by a random forest. Built-in functions and MLlib only.

Candidates are the runs of the alphabet of keys anywhere in a word (JSON, URLs, connection strings, backticks), each with the
name that it is assigned to: of 12 characters or more with a digit, of 20 or more, or of 6 or more if assigned to a word
for credentials. The forest sees its length, its transitions between lower case, upper case, digits and other
characters, the share of different characters, how much of it words of the corpus cover, the path (source) it comes
from, and how much the words around it speak for a secret. It is trained on labelled findings.

No table of findings is given, so ``labelled`` labels those whose case is plain: published key formats and long mixed values
assigned to a word for credentials are secrets; mail addresses, network addresses, plain numbers and plain words are not.
All others are left to the forest. A value in a published format is a secret whatever its score (column ``published``). Training takes at most about ``max_rows`` labelled findings (a parameter); the
dictionary and the scan cover every text.

Scale: words are filtered in their row, only candidates are exploded. The dictionary is a count with partial sums; a
candidate's substrings meet it in an equi-join that shuffles both sides at every size, and what is grouped by candidate is
bounded by its length.

Defined results: null and empty texts have no candidates; a null doc_id or source is a value like any other; each row
counts, equal rows too; without labelled findings of both kinds there is no forest, and every candidate scores 0.5
and stays a secret; several candidates of one word are told apart by ``part``. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monsoon.llm.common import let, row_key, words
from monsoon.session import cut_lineage

#: A run of the alphabet of keys, after the name that it is assigned to, if any. Runs can't be given back, so a word costs one pass.
KEY = r"[A-Za-z0-9+/_.@-]"
RUN = rf"(?:({KEY}++)[\\\"'\])]*+[=:]++[\\\"'`(\[{{<]*+)?({KEY}{{6,}}+(?:={{1,2}}+(?!{KEY}))?)"
#: Characters of a candidate: with a digit, without one, and assigned to a word for credentials.
MIXED, PLAIN, ASSIGNED = 12, 20, 6
#: Words for credentials, and published key formats. Fixed values.
CREDENTIAL = r"(?i)(?:token|password|passwd|pwd|secret|api_?key|access_?key|private_?key|credential)s?$"
FORMAT = r"^(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})$"
HARMLESS = (
    r"^(?:[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[0-9.]+|[0-9+-]+|[A-Za-z]+(?:[._/-][A-Za-z]+)*)$"
)
CLASSES = {"l": "a-z", "u": "A-Z", "d": "0-9"}
#: Lengths of the dictionary's words, and how often a word is found at least.
SHORTEST, LONGEST, LEAST = 4, 8, 5
FEATURES = ["length", *[f"t_{a}{b}" for a in CLASSES for b in CLASSES], "t_other", "different", "dictionary", "path", "around"]


def candidates(docs: DataFrame) -> DataFrame:
    """Every candidate: doc_id, key (of the row), path, at (word number), part (in it), value, before, assigned, after."""
    named = CREDENTIAL.replace("$", r"\W*[=:]+\W*$")

    def near(own: Column) -> Column:
        """Words that can hold a candidate, with what stands beside them."""
        found = F.filter(
            F.transform(own, lambda x, i: F.struct(i.alias("at"), x.alias("word"), F.get(own, i - 1).alias("b1"))),
            lambda s: (F.length(s["word"]) >= MIXED)
            | ((F.length(s["word"]) > ASSIGNED) & s["word"].rlike("[=:]"))
            | ((F.length(s["word"]) >= ASSIGNED) & s["b1"].rlike(f"^[=:]+$|{named}")),
        )
        sides = lambda s: (F.get(own, s["at"] - 2).alias("b2"), F.get(own, s["at"] + 1).alias("a1"))
        return F.transform(found, lambda s: F.struct(s["at"].alias("at"), s["word"].alias("word"), s["b1"].alias("b1"), *sides(s)))

    made = docs.select(
        F.col("doc_id"), row_key(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id()).alias("key"),
        F.pmod(F.xxhash64(F.col("source")), F.lit(64)).alias("path"), let(words(F.col("text")), near).alias("c"),
    )
    made = made.select("doc_id", "key", "path", F.explode_outer("c").alias("c")).filter("c is not null")
    names, values = (F.regexp_extract_all(F.col("c.word"), F.lit(RUN), F.lit(i)) for i in (1, 2))
    made = made.select(
        "doc_id", "key", "path", "c", F.size(values).alias("parts"), F.posexplode_outer(F.arrays_zip(names.alias("name"), values.alias("value")))
    ).filter("col is not null")
    # What the value is assigned to inside the word, or else the words before without the sign of the assignment.
    own, first, sign = F.col("col.name"), F.col("pos") == 0, F.coalesce(F.col("c.b1").rlike("^[=:]+$"), F.lit(False))
    before = F.when(own != "", own).when(first & sign, F.col("c.b2")).when(first, F.col("c.b1"))
    made = made.select(
        "doc_id", "key", "path", F.col("c.at").alias("at"), F.col("pos").alias("part"), F.col("col.value").alias("value"),
        _word(before).alias("before"), ((own != "") | first & (sign | F.coalesce(F.col("c.b1").rlike(r"[=:]\W*$"), F.lit(False)))).alias("assigned"),
        _word(F.when(F.col("pos") == F.col("parts") - 1, F.col("c.a1"))).alias("after"),
    )
    size, credential = F.length("value"), F.col("assigned") & F.col("before").rlike(CREDENTIAL)
    return made.filter((size >= PLAIN) | (size >= MIXED) & F.col("value").rlike("[0-9]") | credential)


def _word(w: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_]+", "")), F.lit(""))


def dictionary(docs: DataFrame) -> DataFrame:
    """Words of SHORTEST to LONGEST small letters found LEAST times or more in the corpus."""
    kept = F.filter(words(F.col("text")), lambda x: F.length(x).between(SHORTEST, LONGEST))
    every = docs.select(F.explode_outer(kept).alias("word")).filter(F.col("word").rlike("^[a-z]+$"))
    return every.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).select("word")


def _coverage(found: DataFrame, known: DataFrame) -> DataFrame:
    """Per hash of a candidate's value the share of its characters inside words of the dictionary."""
    values = found.select(F.xxhash64("value").alias("id"), F.lower("value").alias("value")).distinct()
    # Parts are cut out of an array of characters, so a very long value costs no more per character than a short one.
    values = values.select("id", F.split("value", "").alias("c"))
    part = lambda s: F.transform(
        F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.size("c") - s + 1)),
        lambda n: F.struct(s.alias("s"), n.alias("n"), F.array_join(F.slice("c", s, n), "").alias("word")),
    )
    cut = F.flatten(F.transform(F.sequence(F.lit(1), F.size("c") - (SHORTEST - 1)), part))
    parts = values.select("id", F.size("c").alias("size"), F.explode_outer(cut).alias("p")).select("id", "size", "p.*")
    # A value gives rise to many parts, which the estimate of its table doesn't know: they are never gathered for a broadcast.
    met = parts.filter(F.col("word").rlike("^[a-z]+$")).hint("merge").join(known, "word")
    longest = met.groupBy("id", "size", "s").agg(F.max("n").alias("n"))
    spans = longest.groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("spans"))
    zero = F.struct(F.lit(1).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "spans", zero,
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["s"] + x["n"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["s"] + x["n"] - F.greatest(acc["end"], x["s"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return spans.select("id", (covered / F.col("size")).alias("dictionary"))


def labelled(found: DataFrame) -> DataFrame:
    """Adds ``label``: 1 for plain secrets, 0 for plain harmless findings, else null."""
    value = F.col("value")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike("[@.]") & (F.col("assigned") | (F.length(value) >= 16))
    return found.withColumn(
        "label",
        F.when(value.rlike(FORMAT), 1.0).when(mixed & F.col("before").rlike(CREDENTIAL), 1.0).when(value.rlike(HARMLESS), 0.0),
    )


def _features(found: DataFrame, docs: DataFrame) -> DataFrame:
    value, size = F.col("value"), F.length("value")
    shapes = {f"t_{a}{b}": F.regexp_count(value, F.lit(f"[{x}](?=[{y}])")) / size for a, x in CLASSES.items() for b, y in CLASSES.items()}
    shapes["t_other"] = F.regexp_count(value, F.lit("[^A-Za-z0-9]")) / size
    shapes["different"] = F.size(F.array_distinct(F.split(value, ""))) / size
    covered = found.withColumn("id", F.xxhash64("value")).join(_coverage(found, dictionary(docs)), "id", "left")
    return covered.withColumns({"length": size.cast("double"), "dictionary": F.coalesce("dictionary", F.lit(0.0)), **shapes})


def _evidence(sample: DataFrame) -> DataFrame:
    """Per word before or after a labelled finding the log odds that it is a secret; bounded by the sample."""
    sides = sample.select(F.explode(F.array("before", "after")).alias("word"), "label").filter("word <> ''")
    return sides.groupBy("word").agg(
        F.log((F.sum("label") + 0.5) / (F.sum(1 - F.col("label")) + 0.5)).alias("odds"), F.count("*").alias("n")
    ).filter("n >= 3")


def scan(docs: DataFrame, max_rows: int = 20_000, trees: int = 30, depth: int = 6, seed: int = 5) -> DataFrame:
    """Every candidate: doc_id, at, part, n_chars, value_sha256, before, score, published and secret."""
    found = cut_lineage(candidates(docs))
    marked = cut_lineage(labelled(_features(found, docs)))
    sample = marked.filter("label is not null")
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = min(1.0, max_rows / max(1, sum(counts.values())))
    sample = sample.filter(F.pmod(F.xxhash64("key", "at", "part", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * share))
    odds = cut_lineage(_evidence(sample))

    def around(rows: DataFrame) -> DataFrame:
        out = rows
        for side in ("before", "after"):
            # At most two words for each sampled finding, so at most 2 * max_rows rows.
            own = F.broadcast(odds.select(F.col("word").alias(side), F.col("odds").alias(f"{side}_odds")))
            out = out.join(own, side, "left")
        return out.withColumn("around", F.coalesce("before_odds", F.lit(0.0)) + F.coalesce("after_odds", F.lit(0.0)))

    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    if len(counts) < 2:
        scored = marked.withColumn("score", F.lit(0.5))
    else:
        # One ordered partition: the rows are bounded, and the forest then doesn't depend on the cluster.
        training = cut_lineage(around(sample).select("key", "at", "part", "label", *FEATURES).coalesce(1).sortWithinPartitions("key", "at", "part"))
        forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
        model = forest.fit(assembler.transform(training))
        scored = model.transform(assembler.transform(around(marked)))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        "doc_id", F.col("at").cast("long").alias("at"), "part", F.length("value").cast("long").alias("n_chars"),
        F.sha2("value", 256).alias("value_sha256"), "before", "score", F.col("value").rlike(FORMAT).alias("published"),
        ((F.col("score") >= 0.5) | F.col("value").rlike(FORMAT)).alias("secret"),
    )
