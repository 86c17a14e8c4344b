"""A perceptron of one hidden layer with a penalty on its weights, fitted on all rows at once.

Each step is one pass: tasks sum loss and gradient over their rows, a second stage adds those vectors up in a few
tasks, and the driver, which holds the weights, takes the step. The loss is the mean log loss plus
alpha / (2 * rows) times the sum of squared weights (not of the constants). Labels are 0 and 1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasSeed, HasStepSize, HasTol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gradients that the driver adds up at once, beyond which so many tasks add them before, and pairs of steps and gradients
#: that the curvature is taken from.
ADDERS, MEMORY = 64, 10


class Shape:
    """Weights as one vector: hidden weights, hidden constants, output weights, output constant."""

    def __init__(self, inputs: int, hidden: int):
        self.inputs, self.hidden = inputs, hidden
        self.size = inputs * hidden + 2 * hidden + 1

    def parts(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        n, h = self.inputs * self.hidden, self.hidden
        return v[:n].reshape(self.inputs, h), v[n : n + h], v[n + h : n + 2 * h], v[-1]

    def start(self, seed: int) -> np.ndarray:
        """Weights within the square root of 6 over the sum of a layer's inputs and outputs, constants 0."""
        r, v = np.random.default_rng(seed), np.zeros(self.size)
        n, h = self.inputs * self.hidden, self.hidden
        v[:n] = r.uniform(-1, 1, n) * np.sqrt(6 / (self.inputs + h))
        v[n + h : n + 2 * h] = r.uniform(-1, 1, h) * np.sqrt(6 / (h + 1))
        return v

    def penalised(self, v: np.ndarray) -> np.ndarray:
        """v with 0 for constants."""
        out, n, h = v.copy(), self.inputs * self.hidden, self.hidden
        out[n : n + h] = out[-1] = 0
        return out

    def logits(self, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.parts(v)
        return np.maximum(x @ w + b, 0) @ u + c

    def summed(self, v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient of the summed log loss, and behind it that loss."""
        w, b, u, c = self.parts(v)
        hidden = np.maximum(x @ w + b, 0)
        z = hidden @ u + c
        d = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        back = np.outer(d, u) * (hidden > 0)
        return np.concatenate([(x.T @ back).ravel(), back.sum(0), hidden.T @ d, [d.sum()], [(np.logaddexp(0, z) - y * z).sum()]])


class PerceptronModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol):
    def __init__(self, shape: Shape, weights: np.ndarray, losses: list[float]):
        super().__init__()
        self.shape, self.weights, self.losses = shape, weights, losses

    def _transform(self, df: DataFrame) -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast((self.shape, self.weights))

        def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            shape, weights = model.value
            for vectors in batches:
                x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, shape.inputs))
                yield pd.Series(1 / (1 + np.exp(-np.clip(shape.logits(weights, x), -500, 500))))

        shares.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        df = df.withColumn("__share", F.pandas_udf(shares, "double")(vector_to_array(self.getFeaturesCol())))
        probability = array_to_vector(F.array(1 - F.col("__share"), F.col("__share")))
        return df.withColumns({self.getProbabilityCol(): probability, self.getPredictionCol(): (F.col("__share") > 0.5).cast("double")}).drop("__share")


class Perceptron(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasMaxIter, HasStepSize, HasTol, HasSeed):
    hidden = Param(Params._dummy(), "hidden", "units of the hidden layer", TypeConverters.toInt)
    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)
    solver = Param(Params._dummy(), "solver", "l-bfgs, adam or gd", TypeConverters.toString)

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(hidden=100, alpha=1.0, solver="l-bfgs", maxIter=200, stepSize=0.001, tol=1e-4, seed=13)
        self._set(**settings)

    def setFeaturesCol(self, value: str) -> Perceptron:
        return self._set(featuresCol=value)

    def _fit(self, df: DataFrame) -> PerceptronModel:
        rows = df.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")).cache()
        head = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).first()
        shape, tasks = Shape(head["p"] or 0, self.getOrDefault("hidden")), rows.rdd.getNumPartitions()
        loss = lambda v: penalised_loss(rows, shape, v, self.getOrDefault("alpha"), head["n"], tasks)
        start = shape.start(self.getSeed())
        steps = {"l-bfgs": _lbfgs, "adam": _adam, "gd": _descent}[self.getOrDefault("solver")]
        weights, losses = steps(loss, start, self.getMaxIter(), self.getStepSize(), self.getTol()) if head["n"] else (start, [])
        rows.unpersist()
        model = PerceptronModel(shape, weights, losses)
        return model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol())


def penalised_loss(rows: DataFrame, shape: Shape, v: np.ndarray, alpha: float, n: int, tasks: int = ADDERS + 1) -> tuple[float, np.ndarray]:
    """Loss and gradient at v over all rows (x, y), which so many tasks read."""
    at = rows.sparkSession.sparkContext.broadcast(v)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, any_row = np.zeros(shape.size + 1), False
        for b in batches:
            if len(b):
                total, any_row = total + shape.summed(at.value, np.stack(b.x.to_numpy()), b.y.to_numpy()), True
        if any_row:
            yield pd.DataFrame({"v": [total.tobytes()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape.size + 1)
        for b in batches:
            for one in b.v:
                total += np.frombuffer(one)
        yield pd.DataFrame({"v": [total.tobytes()]})

    parts = rows.mapInPandas(summed, "v binary")
    if tasks > ADDERS:
        parts = parts.repartition(ADDERS).mapInPandas(added, "v binary")
    total = np.sum([np.frombuffer(r["v"]) for r in parts.collect()], axis=0)
    at.unpersist()
    w = shape.penalised(v)
    return float(total[-1] / n + alpha * (w @ w) / (2 * n)), total[:-1] / n + alpha * w / n


def _lbfgs(loss, v: np.ndarray, steps: int, rate: float, tol: float) -> tuple[np.ndarray, list[float]]:
    """Steps along the gradient, turned by the curvature that the last ones showed, halved until the loss falls enough."""
    now, g = loss(v)
    losses, pairs = [now], []
    for _ in range(steps):
        d, alphas = -g, []
        for s, y in reversed(pairs):
            alphas.append(s @ d / (s @ y))
            d = d - alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            d = d + (a - y @ d / (s @ y)) * s
        length = 1.0 if pairs else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))
        while True:
            after, g_after = loss(v + length * d)
            if after <= now + 1e-4 * length * (g @ d) or length < 1e-8:
                break
            length /= 2
        if after >= now:
            break
        s, y = length * d, g_after - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-MEMORY:]
        v, fell, now, g = v + s, now - after, after, g_after
        losses.append(now)
        if fell <= tol * max(abs(now), 1e-12) or np.abs(g).max() < 1e-8:
            break
    return v, losses


def _descent(loss, v: np.ndarray, steps: int, rate: float, tol: float) -> tuple[np.ndarray, list[float]]:
    losses = []
    for _ in range(steps):
        now, g = loss(v)
        losses.append(now)
        v = v - rate * g
    return v, losses


def _adam(loss, v: np.ndarray, steps: int, rate: float, tol: float) -> tuple[np.ndarray, list[float]]:
    """Steps by the running mean of gradients over the root of that of their squares."""
    losses, m, q = [], np.zeros_like(v), np.zeros_like(v)
    for t in range(1, steps + 1):
        now, g = loss(v)
        losses.append(now)
        m, q = 0.9 * m + 0.1 * g, 0.999 * q + 0.001 * g * g
        v = v - rate * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
    return v, losses
