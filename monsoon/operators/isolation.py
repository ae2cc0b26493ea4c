"""Isolation forest and the two-layer anomaly verdict.

Growing: every tree needs 256 rows, so a pool of rows is picked by a hash of the row key, each
tree draws its rows from the pool by a second hash, and the trees grow in parallel, one small
group each. Scoring: the trees (a few tens of thousands of nodes at most) travel to the tasks
and each Arrow batch walks all trees at once.
"""

from __future__ import annotations

import json
import logging
import math
from collections import deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monsoon.functions.rounding import round_scalar
from monsoon.operators.contract import rule_flags
from monsoon.operators.order_stats import column_quantiles, quantiles

log = logging.getLogger("monsoon")

TREES, SAMPLE, CONTAMINATION, SEED = 100, 256, 0.05, 42
ANOMALY_FEATURES = ["suhu_c", "kelembaban_pct", "curah_hujan_mm", "kecepatan_angin_kmh"]
FOREST_REASON = "isolation_forest"
_NODE_SCHEMA = "tree int, node int, feature int, threshold double, child int, length double"
_EULER = 0.5772156649015329


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    grown = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + _EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, grown, np.where(n == 2, 1.0, 0.0))


def _grow(features: Sequence[str], sample: int, seed: int):
    """Grower of one tree from its drawn rows."""

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        x = pdf.nsmallest(sample, "rank")[list(features)].to_numpy(dtype="float64")
        rng = np.random.default_rng([seed, tree])
        deepest = math.ceil(math.log2(max(len(x), 2)))
        # Breadth first: the right child of a node directly follows its left child.
        nodes, waiting = [[tree, 0, -1, 0.0, -1, 0.0]], deque([(0, np.arange(len(x)), 0)])
        while waiting:
            at, rows, depth = waiting.popleft()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= deepest or len(rows) <= 1 or len(usable) == 0:
                nodes[at][5] = depth + float(average_path(len(rows)))
                continue
            f = int(rng.choice(usable))
            threshold = float(rng.uniform(low[f], high[f]))
            left = x[rows, f] <= threshold
            child = len(nodes)
            nodes[at][2:5] = [f, threshold, child]
            nodes += [[tree, child, -1, 0.0, -1, 0.0], [tree, child + 1, -1, 0.0, -1, 0.0]]
            waiting += [(child, rows[left], depth + 1), (child + 1, rows[~left], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "child", "length"])

    return grow


@dataclass
class IsolationForest:
    """A fitted forest: its nodes, the fill values, and the score below which a row is an outlier."""

    features: list[str]
    medians: dict[str, float]
    nodes: pd.DataFrame
    sample_size: int
    offset: float | None = None

    # -------------------------------------------------------- scoring

    def filled(self) -> list[Column]:
        return [
            F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(self.medians[c])))
            for c in self.features
        ]

    def score(self) -> Column:
        """Score of a row, in [-1, 0): the lower, the more isolated."""
        nodes = self.nodes.sort_values(["tree", "node"])
        size = nodes.groupby("tree").size().to_numpy()
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        shift = np.repeat(start, size)
        feature = nodes["feature"].to_numpy()
        leaf = feature < 0
        # A leaf leads back to itself, so all walks may take the same number of steps.
        child = np.where(leaf, np.arange(len(nodes)), nodes["child"].to_numpy() + np.repeat(start, size))
        threshold = np.where(leaf, np.inf, nodes["threshold"].to_numpy())
        feature, length = np.maximum(feature, 0), nodes["length"].to_numpy()
        steps = math.ceil(math.log2(max(self.sample_size, 2)))
        norm = float(average_path(self.sample_size))

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype="float64") for c in columns])
            flat, row = x.ravel(), np.arange(len(x)) * x.shape[1]
            total = np.zeros(len(x))
            for root in start:
                at = np.full(len(x), root)
                for _ in range(steps):
                    at = child[at] + (flat[row + feature[at]] > threshold[at])
                total += length[at]
            mean = total / len(start)
            return pd.Series(-np.exp2(-mean / norm) if norm else np.full(len(x), -0.5))

        return score(*self.filled())

    # -------------------------------------------------------- storage

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, _NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        about = {"features": self.features, "medians": self.medians, "sample_size": self.sample_size, "offset": self.offset}
        text = spark.createDataFrame([(json.dumps(about),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        nodes = spark.read.schema(_NODE_SCHEMA).parquet(f"{path}/nodes").toPandas()
        return cls(nodes=nodes, **about)


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    key: str = "id",
    contamination: float = CONTAMINATION,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> IsolationForest:
    """Grow the forest and take its threshold from the scores of all training rows."""
    found = column_quantiles(df, list(features), [0.5])
    medians = {c: (q[0] if q[0] is not None else 0.0) for c, q in found.items()}
    forest = IsolationForest(list(features), medians, pd.DataFrame(), sample)
    rows = df.select(key, *[c.alias(n) for n, c in zip(features, forest.filled(), strict=True)])
    total = df.count()
    forest.sample_size = min(sample, total)

    # Numbers in [0, 1) that depend on the row alone, so a rerun draws the same rows.
    rows = rows.withColumn("__row", F.xxhash64(key, *features, F.lit(seed)))

    def rank(tree: Column) -> Column:
        return F.pmod(F.xxhash64(F.col("__row"), tree), F.lit(1 << 52)).cast("double") / float(1 << 52)

    # Twice the wanted rows on average: a tree short of rows is out of the question. A row is copied only for the
    # trees that draw it.
    draw = min(1.0, 2.0 * sample / max(total, 1))
    own_trees = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: rank(t) < draw)
    tagged = rows.withColumn("tree", F.explode_outer(own_trees)).filter(F.col("tree").isNotNull())
    tagged = tagged.withColumn("rank", rank(F.col("tree"))).drop("__row")
    # Each group holds about twice the sample; the exact number is cut inside the tree.
    forest.nodes = tagged.groupBy("tree").applyInPandas(_grow(features, sample, seed), _NODE_SCHEMA).toPandas()
    scored = df.select(forest.score().alias("score"))
    forest.offset = quantiles(scored, "score", [contamination], computed=True)[0]
    return forest


def detect_anomalies(
    df: DataFrame,
    features: Sequence[str] = ANOMALY_FEATURES,
    forest: IsolationForest | None = None,
    contract: Mapping | None = None,
    contamination: float = CONTAMINATION,
    key: str = "id",
    legacy_reason: bool = False,
) -> DataFrame:
    """Add rule_flag, forest_flag, is_anomaly, anomaly_score and reason.

    A row is anomalous when it breaks a range or the forest isolates it. Without a forest one is
    fitted on the input itself, which says little about a handful of rows. ``legacy_reason``
    reports OK for rows only the forest found.
    """
    if forest is None:
        log.warning("no fitted forest given: fitting one on the input itself")
        forest = fit_forest(df, features, key, contamination)
    scored = rule_flags(df, contract).withColumn("__score", forest.score())
    flagged = scored.withColumn("forest_flag", F.col("__score") < F.lit(forest.offset))
    reason = F.col("rule_reason")
    if not legacy_reason:
        reason = F.when(F.col("forest_flag") & ~F.col("rule_flag"), F.lit(FOREST_REASON)).otherwise(reason)
    return flagged.withColumns(
        {
            "is_anomaly": F.col("rule_flag") | F.col("forest_flag"),
            "anomaly_score": -F.col("__score"),
            "reason": reason,
        }
    ).drop("__score", "rule_reason")


def anomaly_verdict(detected: DataFrame, legacy_method: bool = False) -> DataFrame:
    """Add ``method`` (both, rule, isolation_forest; rule for clean rows) and round the score."""
    rule, forest = F.col("rule_flag"), F.col("forest_flag")
    method = F.when(rule & forest & F.lit(not legacy_method), F.lit("both"))
    method = method.when(forest & ~rule, F.lit(FOREST_REASON)).otherwise(F.lit("rule"))
    return detected.withColumns({"method": method, "anomaly_score": round_scalar(F.col("anomaly_score"), 4)})
