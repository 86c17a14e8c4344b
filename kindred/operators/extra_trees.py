"""Extremely randomized trees: every split takes the best of a few features at one random threshold each.

All trees of a group grow together, a level at a time, in two passes over the rows: the ranges of the drawn features in
each open node, then how many rows, and how many of label 1, lie at or below the drawn thresholds. Tasks work on
arrays and send a row a node and drawn feature; Spark adds them up; the driver draws and chooses, so it holds what the
model holds: the nodes. Draws depend on seed, tree, node and feature alone, so neither partitions nor repeats change a tree.

Labels are 0 and 1. Features that do not vary in a node give no split there: the next ones of its order are drawn,
until all were. Without rows the model has one leaf a tree, of share 0.5."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed, HasWeightCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trees that grow together.
TOGETHER = 32


def uniform(seed: int, tree: np.ndarray, node: np.ndarray, feature: np.ndarray, purpose: int) -> np.ndarray:
    """Numbers in [0, 1) that the arguments settle."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed % 2**63) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(purpose)
        for part in (tree, node, feature):
            x = (x ^ np.asarray(part, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def impurity(share: np.ndarray, kind: str) -> np.ndarray:
    if kind == "gini":
        return 2 * share * (1 - share)
    p = np.clip(np.stack([share, 1 - share]), 1e-300, 1)
    return -(p * np.log2(p)).sum(0)


@dataclass
class Tree:
    """Arrays of nodes in order of creation: feature (-1: leaf), threshold, first of two children, weight, and weight of label 1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    child: list[int] = field(default_factory=lambda: [-1])
    weight: list[float] = field(default_factory=lambda: [0.0])
    positive: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, threshold: float, weights, positives) -> int:
        first = len(self.feature)
        self.feature[node], self.threshold[node], self.child[node] = feature, threshold, first
        for w, p in zip(weights, positives, strict=True):
            for values, v in ((self.feature, -1), (self.threshold, 0.0), (self.child, -1), (self.weight, w), (self.positive, p)):
                values.append(v)
        return first

    def share(self) -> np.ndarray:
        w = np.array(self.weight)
        return np.where(w > 0, self.positive / np.maximum(w, 1e-300), 0.5)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.threshold), np.array(self.child), self.share()


def leaves(arrays: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The node that each row ends in."""
    feature, threshold, child, _ = arrays
    at = np.zeros(len(x), np.int64)
    going = np.flatnonzero(feature[at] >= 0)
    while len(going):
        f = feature[at[going]]
        at[going] = child[at[going]] + (x[going, f] > threshold[at[going]])
        going = going[feature[at[going]] >= 0]
    return at


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 0))


class ExtraTreesModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol):
    """Shares of label 1, averaged over the trees."""

    def __init__(self, trees: list[Tree], importances: np.ndarray):
        super().__init__()
        self.trees, self.featureImportances = trees, DenseVector(importances)

    def _transform(self, df: DataFrame) -> DataFrame:
        trees = df.sparkSession.sparkContext.broadcast([t.arrays() for t in self.trees])

        def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in batches:
                x = _matrix(vectors)
                yield pd.Series(np.mean([t[3][leaves(t, x)] for t in trees.value], axis=0) if len(x) else np.zeros(0))

        shares.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        df = df.withColumn("__share", F.pandas_udf(shares, "double")(vector_to_array(self.getFeaturesCol())))
        probability = array_to_vector(F.array(1 - F.col("__share"), F.col("__share")))
        return df.withColumns({self.getProbabilityCol(): probability, self.getPredictionCol(): (F.col("__share") > 0.5).cast("double")}).drop("__share")


class ExtraTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed, HasWeightCol):
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels below the root", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least weight of a child", TypeConverters.toInt)
    impurity = Param(Params._dummy(), "impurity", "gini or entropy", TypeConverters.toString)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "features drawn for a split: sqrt, log2 or all", TypeConverters.toString)

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=100, minInstancesPerNode=1, impurity="gini", featureSubsetStrategy="sqrt", seed=13)
        self._set(**settings)

    def setFeaturesCol(self, value: str) -> ExtraTrees:
        return self._set(featuresCol=value)

    def _drawn(self, p: int) -> int:
        return {"sqrt": ceil(sqrt(p)), "log2": max(1, ceil(log2(p))) if p > 1 else 1, "all": p}[self.getOrDefault("featureSubsetStrategy")]

    def _fit(self, df: DataFrame) -> ExtraTreesModel:
        weight = F.col(self.getWeightCol()) if self.isSet("weightCol") else F.lit(1.0)
        rows = df.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), weight.cast("double").alias("w")).cache()
        head = rows.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("pos"), F.max(F.size("x")).alias("p")).first()
        total, positive, p = head["w"] or 0.0, head["pos"] or 0.0, head["p"] or 0
        trees, gains = [], np.zeros(p)
        for start in range(0, self.getOrDefault("numTrees"), TOGETHER):
            numbers = list(range(start, min(start + TOGETHER, self.getOrDefault("numTrees"))))
            grown, gained = self._grow(rows, numbers, total, positive, p)
            trees += grown
            for g in gained:
                gains += g / g.sum() if g.sum() else g
        rows.unpersist()
        model = ExtraTreesModel(trees, gains / gains.sum() if gains.sum() else gains)
        return model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol())

    def _grow(self, rows: DataFrame, numbers: list[int], total: float, positive: float, p: int) -> tuple[list[Tree], list[np.ndarray]]:
        seed, k, least, kind = self.getSeed(), self._drawn(p) if p else 0, self.getOrDefault("minInstancesPerNode"), self.getOrDefault("impurity")
        trees, gains = [Tree() for _ in numbers], [np.zeros(p) for _ in numbers]
        for t in trees:
            t.weight[0], t.positive[0] = total, positive
        # Open nodes: tree, node, level, and from which place of the node's order of features the next are drawn.
        open_nodes = [(t, 0, 0, 0) for t in range(len(numbers))] if 0 < positive < total and self.getOrDefault("maxDepth") > 0 else []
        while open_nodes:
            tree, node, _, place = (np.array(c) for c in zip(*open_nodes, strict=True))
            order = np.argsort(uniform(seed, np.array(numbers)[tree][:, None], node[:, None], np.arange(p)[None, :], 1), axis=1, kind="stable")
            # Places beyond the last feature draw the last one again.
            drawn = order[np.arange(len(order))[:, None], np.minimum(place[:, None] + np.arange(k), p - 1)]
            low, high = _ranges(rows, trees, tree, node, drawn)
            u = uniform(seed, np.array(numbers)[tree][:, None], node[:, None], drawn, 2)
            threshold = np.where(high > low, low + (high - low) * u, np.nan)
            # Rounding must not put all rows on one side.
            threshold = np.where(threshold >= high, low, threshold)
            weight, pos = _counts(rows, trees, tree, node, drawn, threshold)
            own, own_pos = (np.array([getattr(trees[t], c)[n] for t, n, *_ in open_nodes])[:, None] for c in ("weight", "positive"))
            other, other_pos = own - weight, own_pos - pos
            fits = (high > low) & (weight >= least) & (other >= least) & (weight > 0) & (other > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                left, right = np.clip(pos / weight, 0, 1), np.clip(other_pos / other, 0, 1)
                gain = np.where(fits, own * impurity(own_pos / own, kind) - weight * impurity(left, kind) - other * impurity(right, kind), -np.inf)
            best, following = np.argmax(gain, axis=1), []
            for i, (t, n, level, at) in enumerate(open_nodes):
                j = best[i]
                if gain[i, j] == -np.inf:
                    if at + k < p:
                        following.append((t, n, level, at + k))
                    continue
                sides = (float(weight[i, j]), float(other[i, j])), (float(pos[i, j]), float(other_pos[i, j]))
                first = trees[t].split(n, int(drawn[i, j]), float(threshold[i, j]), *sides)
                gains[t][drawn[i, j]] += max(gain[i, j], 0.0)
                following += [(t, c, level + 1, 0) for c, w, one in zip((first, first + 1), *sides, strict=True) if 0 < one < w and w >= 2 * least and level + 1 < self.getOrDefault("maxDepth")]
            open_nodes = following
        return trees, gains


def _nodes_of(rows: DataFrame, trees: list[Tree], tree: np.ndarray, node: np.ndarray, use, schema: str) -> DataFrame:
    """use(x, y, w, rows, open) of each task's arrays: which rows lie in which of the open nodes."""
    model = rows.sparkSession.sparkContext.broadcast(([t.arrays() for t in trees], tree, node))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays, tree, node = model.value
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.x)
            for t in np.unique(tree):
                place = np.full(len(arrays[t][0]), -1)
                mine = np.flatnonzero(tree == t)
                place[node[mine]] = mine
                at = place[leaves(arrays[t], x)]
                inside = np.flatnonzero(at >= 0)
                if len(inside):
                    yield use(x[inside], b.y.to_numpy()[inside], b.w.to_numpy()[inside], at[inside])

    return rows.mapInPandas(run, schema)


def _ranges(rows: DataFrame, trees: list[Tree], tree: np.ndarray, node: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest value of each open node's drawn features."""

    def use(x, y, w, at):
        found, at = np.unique(at, return_inverse=True)
        out = []
        for k in range(drawn.shape[1]):
            v, low, high = x[np.arange(len(x)), drawn[found[at], k]], np.full(len(found), np.inf), np.full(len(found), -np.inf)
            np.minimum.at(low, at, v)
            np.maximum.at(high, at, v)
            out.append(pd.DataFrame({"i": found, "k": k, "low": low, "high": high}))
        return pd.concat(out)

    sent = _nodes_of(rows, trees, tree, node, use, "i long, k int, low double, high double")
    low, high = np.full(drawn.shape, np.inf), np.full(drawn.shape, -np.inf)
    # A row an open node and drawn feature.
    got = sent.groupBy("i", "k").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    i, k = got.column("i").to_numpy(), got.column("k").to_numpy()
    low[i, k], high[i, k] = got.column("low").to_numpy(), got.column("high").to_numpy()
    return low, high


def _counts(rows: DataFrame, trees: list[Tree], tree: np.ndarray, node: np.ndarray, drawn: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight, and weight of label 1, at or below each threshold."""

    def use(x, y, w, at):
        found, at = np.unique(at, return_inverse=True)
        out = []
        for k in range(drawn.shape[1]):
            below = x[np.arange(len(x)), drawn[found[at], k]] <= threshold[found[at], k]
            out.append(pd.DataFrame({"i": found, "k": k, "w": np.bincount(at, below * w, len(found)), "pos": np.bincount(at, below * w * y, len(found))}))
        return pd.concat(out)

    sent = _nodes_of(rows, trees, tree, node, use, "i long, k int, w double, pos double")
    weight, pos = np.zeros(drawn.shape), np.zeros(drawn.shape)
    got = sent.groupBy("i", "k").agg(F.sum("w").alias("w"), F.sum("pos").alias("pos")).toArrow()
    i, k = got.column("i").to_numpy(), got.column("k").to_numpy()
    weight[i, k], pos[i, k] = got.column("w").to_numpy(), got.column("pos").to_numpy()
    return weight, pos
