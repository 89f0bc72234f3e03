"""Isolation forest over joint metrics (Liu, Ting and Zhou, ICDM 2008).

Each tree is grown from a subsample of about 256 rows drawn in Spark, one task group per
tree. Rows are drawn by a hash of their content, so the forest depends on the data alone, not on
how it is partitioned, and a task that is run again draws the same rows. The finished forest is
a few thousand nodes whatever the input size, so it travels with the scoring function; scoring is
one Arrow pass with no shuffle.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spindlewatch.functions.quantiles import grouped_statistics
from spindlewatch.operators.detect import lineage
from spindlewatch.schema import (
    CONTAMINATION, DETECTION_SCHEMA, FOREST_MIN_ROWS, FOREST_SEED,
)
from spindlewatch.session import stage

TREES = 100
SUBSAMPLE = 256

# The functions below run on executors; sent by value, they need no installed package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow(tree: int, points: np.ndarray, seed: int) -> list[tuple]:
    """Nodes of one tree; a leaf has feature -1 and its expected depth."""
    points = points[np.lexsort(points.T[::-1])]  # arrival order must not matter
    rng = np.random.default_rng([seed, tree])
    ceiling = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[tuple] = []

    def split(rows: np.ndarray, depth: int) -> int:
        node = len(nodes)
        nodes.append(None)
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= ceiling or len(rows) <= 1 or len(varying) == 0:
            nodes[node] = (tree, node, -1, 0.0, -1, -1, depth + mean_path(len(rows)))
            return node
        feature = int(rng.choice(varying))
        cut = float(rng.uniform(low[feature], high[feature]))
        below = rows[:, feature] <= cut
        left, right = split(rows[below], depth + 1), split(rows[~below], depth + 1)
        nodes[node] = (tree, node, feature, cut, left, right, 0.0)
        return node

    split(points, 0)
    return nodes


def _subsamples(rows: DataFrame, distinct: int, trees: int, subsample: int, seed: int) -> DataFrame:
    """Rows labelled with the tree they help grow, about `subsample` per tree.

    One draw per row, from the hash of all its columns, places it in one of distinct/subsample
    slots, of which the first `trees` are kept. Inputs too small for that many disjoint samples
    are drawn from repeatedly. Rows equal in every column are drawn together and count once, so a
    tree's sample is bounded however often a row is repeated.
    """
    slots = distinct / min(subsample, distinct)
    per_round = max(1, int(slots))
    rounds = -(-trees // per_round)
    places = F.sequence(F.lit(0), F.lit(rounds - 1))
    draw = F.pmod(F.xxhash64(F.lit(seed), "_round", *rows.columns), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return (
        rows.withColumn("_round", F.explode(places))
        .withColumn("_slot", F.floor(draw * slots).cast("int")).where(F.col("_slot") < per_round)
        .withColumn("tree", F.col("_round") * per_round + F.col("_slot"))
        .where(F.col("tree") < trees)
        .drop("_round", "_slot").distinct()
    )


class Forest:
    """Flat node arrays, one offset per tree."""

    def __init__(self, nodes: pd.DataFrame, sample: int):
        nodes = nodes.sort_values(["tree", "node"])
        self.roots = np.flatnonzero(nodes["node"].to_numpy() == 0)
        base = np.repeat(self.roots, np.diff(np.append(self.roots, len(nodes))))
        self.feature = nodes["feature"].to_numpy()
        self.cut = nodes["cut"].to_numpy()
        self.left = nodes["left"].to_numpy() + base
        self.right = nodes["right"].to_numpy() + base
        self.depth = nodes["depth"].to_numpy()
        self.norm = mean_path(sample)

    def score(self, points: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]; larger is more isolated."""
        total = np.zeros(len(points))
        row = np.arange(len(points))
        for root in self.roots:
            at = np.full(len(points), root)
            while True:
                feature = self.feature[at]
                inner = feature >= 0
                if not inner.any():
                    break
                value = points[row, np.where(inner, feature, 0)]
                step = np.where(value <= self.cut[at], self.left[at], self.right[at])
                at = np.where(inner, step, at)
            total += self.depth[at]
        return np.exp2(-total / len(self.roots) / self.norm)


def _features(df: DataFrame, metrics: list[str]) -> list:
    return [F.coalesce(F.nanvl(F.col(m).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_f{i}")
            for i, m in enumerate(metrics)]


def fit_forest(df: DataFrame, metrics: list[str], seed: int = FOREST_SEED,
               trees: int = TREES, subsample: int = SUBSAMPLE) -> Forest:
    """Grow the forest on executors and collect its nodes (bounded by trees * 2 * subsample).

    A row's identity is its device, timestamp and run, where present, and its metrics.
    """
    names = [f"_f{i}" for i in range(len(metrics))]
    identity = [c for c in ("device", "timestamp", "ingest_run_id") if c in df.columns]
    rows = df.select(*_features(df, metrics), *identity)
    # A sketch of fixed size, the same for every partitioning.
    distinct = rows.agg(F.approx_count_distinct(F.xxhash64(*rows.columns), 0.01)).first()[0]

    def build(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        nodes = grow(int(key[0]), sample[names].to_numpy(dtype=float), seed)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "depth"])

    sampled = _subsamples(rows, distinct, trees, subsample, seed).select("tree", *names)
    nodes = sampled.groupBy("tree").applyInPandas(build, _NODE_SCHEMA).toPandas()
    return Forest(nodes, min(subsample, distinct))


def score_rows(df: DataFrame, metrics: list[str], forest: Forest) -> DataFrame:
    """Add `isolation_score` to every row."""
    @F.pandas_udf(T.DoubleType())
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    features = _features(df, metrics)
    return df.withColumn("isolation_score", score(*features))


def detect_isolation_forest(df: DataFrame, metrics: list[str],
                            contamination: float = CONTAMINATION, seed: int = FOREST_SEED,
                            trees: int = TREES, subsample: int = SUBSAMPLE) -> DataFrame:
    """Events for the `contamination` share of rows that are easiest to isolate.

    One model for the whole frame; fewer than ten rows give no events. The event's score is
    the distance past the cut-off.
    """
    spark: SparkSession = df.sparkSession
    rows = df.count()
    if rows < FOREST_MIN_ROWS:
        return spark.createDataFrame([], DETECTION_SCHEMA)
    forest = fit_forest(df, metrics, seed, trees, subsample)
    # Scored once and written down: the cut-off needs several looks at the scores.
    scored = stage(score_rows(
        df.selectExpr("device", "timestamp", *lineage(df), *metrics), metrics, forest
    ).drop(*metrics), "isolation-scores")
    cut = grouped_statistics(
        scored.withColumnRenamed("isolation_score", "score"), [], ["score"],
        [1.0 - contamination]).select(F.col("score").q[0]).scalar()
    past = F.col("isolation_score") - F.col("_cut")
    return scored.withColumn("_cut", cut).where(past > 0).select(
        "device", "timestamp",
        F.lit("multivariate").alias("metric_name"),
        past.alias("metric_value"),
        F.lit("isolation_forest").alias("detector_type"),
        past.alias("anomaly_score"),
        F.lit(None).cast("string").alias("severity"),
        F.lit(1).alias("is_anomaly"),
        F.lit("metrics=" + ",".join(metrics)).alias("details"),
        "source_file", "ingest_run_id",
    )
