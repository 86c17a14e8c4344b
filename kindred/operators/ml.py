"""Classifiers on pair features with pyspark.ml: tuning, feature elimination, training and reports."""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, PolynomialExpansion, VectorAssembler, VectorSlicer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import counted, ratios
from .extra_trees import ExtraTrees
from .perceptron import Perceptron

SEED, FOLDS, KEEP = 13, 5, 20
#: Trees of both forests, rounds of boosting, penalty and steps of the linear machine.
TREES, EXTRA, ROUNDS, C, STEPS = 908, 300, 988, 1.0, 3000


def classifiers(n_features: int, trees: int | None = None, rows: int | None = None) -> dict:
    """The seven classifiers. XGBoost stands as gradient-boosted trees; depths of MLlib's own trees end at 30, as deep
    as they go. trees takes the place of TREES, EXTRA, ROUNDS and the perceptron's steps; rows, how many the machine is fitted on, turns C into the weight that MLlib asks for."""
    forest, rounds = trees or TREES, trees or ROUNDS
    return {
        "lsvm": LinearSVC(maxIter=STEPS, regParam=1 / (C * rows) if rows else 0.01),
        "dt": DecisionTreeClassifier(maxDepth=30, seed=SEED),
        "rf": RandomForestClassifier(numTrees=forest, maxDepth=16, impurity="entropy", featureSubsetStrategy="log2", minInstancesPerNode=3, seed=SEED),
        "nn": Perceptron(hidden=100, alpha=1.0, maxIter=trees or 200, seed=SEED),
        "nb": NaiveBayes(modelType="gaussian"),
        "et": ExtraTrees(numTrees=trees or EXTRA, maxDepth=100, seed=SEED),
        "xgboost": GBTClassifier(maxIter=rounds, maxDepth=5, stepSize=0.1, subsamplingRate=0.7, seed=SEED),
    }


def chosen(names, n_features: int, trees: int | None = None, rows: int | None = None) -> dict:
    every = classifiers(n_features, trees, rows)
    wanted = list(every) if "all" in names else names
    unknown = [n for n in wanted if n not in every]
    if unknown:
        raise ValueError(f"no such classifier: {', '.join(unknown)}; there are {', '.join(every)}")
    return {n: every[n] for n in wanted}


#: Grids of the search for each classifier, so far as MLlib has the parameters. C is that of the machine,
#: per row (see settings); weightCol names a column of ones or of weights that make both labels count alike.
GRIDS = {
    "lsvm": {"C": [1.0, 10.0, 100.0, 1000.0], "maxIter": [STEPS]},
    "dt": {"maxDepth": [5, 10, 15, 20, 25, 30], "minInstancesPerNode": [1, 2, 4, 10]},
    "rf": {"maxDepth": [10, 20, 30], "impurity": ["gini", "entropy"], "minInstancesPerNode": [1, 2, 4], "numTrees": [250, 500, 1000]},
    "et": {"maxDepth": [10, 20, 30], "impurity": ["gini", "entropy"], "minInstancesPerNode": [1, 2, 4], "numTrees": [250, 500, 1000]},
    "xgboost": {"maxDepth": [3, 5, 10], "stepSize": [0.01, 0.1, 0.2], "subsamplingRate": [0.8, 0.9, 1.0]},
    "nn": {"stepSize": [0.001, 0.01, 0.1], "maxIter": [300, 500, 1000], "solver": ["gd", "adam"]},
    "nb": {"smoothing": [1e-9, 1e-6, 1e-3]},
}
_whole = lambda low, high: lambda r: int(r.integers(low, high))
_one_of = lambda *values: lambda r: values[int(r.integers(len(values)))]


def _truncated(low: float, high: float):
    """A standard normal number between low and high."""

    def draw(r):
        while not low <= (x := abs(r.normal())) <= high:
            pass
        return float(x)

    return draw


_FOREST = {
    "maxDepth": lambda r: min(int(r.integers(3, 100)), 30),
    "impurity": _one_of("gini", "entropy"),
    "featureSubsetStrategy": _one_of("sqrt", "log2"),
    "minInstancesPerNode": _whole(1, 5),
    "numTrees": _whole(10, 1000),
    "weightCol": _one_of("unit", "balanced"),
}
#: Distributions of the random search, as functions of a generator; depths beyond MLlib's end at 30.
DRAWS = {
    "lsvm": {"C": lambda r: 0.01 + r.exponential(20), "tol": _one_of(1e-3, 1e-4), "maxIter": _one_of(STEPS)},
    "dt": {"maxDepth": lambda r: min(int(r.integers(10, 100)), 30), "minInstancesPerNode": _whole(1, 5)},
    "rf": {"bootstrap": _one_of(True, False), **_FOREST},
    "et": _FOREST | {"maxDepth": _whole(3, 100)},
    "xgboost": {
        "maxIter": _whole(100, 3000), "stepSize": lambda r: float(min(1.0, 0.01 + r.exponential(0.1))), "maxDepth": lambda r: min(int(r.integers(3, 60)), 30),
        "subsamplingRate": _truncated(0.3, 1), "featureSubsetStrategy": lambda r: str(round(_truncated(0.3, 1)(r), 3)), "minInstancesPerNode": _whole(1, 6),
    },
    "nn": {"stepSize": lambda r: 0.0001 + r.exponential(0.1), "maxIter": _one_of(300, 500, 1000), "solver": _one_of("gd", "adam")},
    "nb": {"smoothing": lambda r: float(10 ** r.uniform(-9, -3))},
}


def settings(values: dict, rows: int, trees: int | None = None) -> dict:
    """A setting in MLlib's terms: C, which weighs the rows' sum, as the penalty of their mean; trees takes the place of numbers of trees, rounds and the perceptron's steps."""
    out = {k: v for k, v in values.items() if k != "C"}
    if "C" in values:
        out["regParam"] = 1 / (values["C"] * rows)
    return out | ({k: trees for k in ("numTrees",) if k in out} if trees else {}) | ({"maxIter": trees} if trees and "maxIter" in out and {"maxDepth", "solver"} & set(out) else {})


def weighed(df: DataFrame) -> DataFrame:
    """df with unit, ones, and balanced, weights by which each label has half of all weight."""
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    total, weight = sum(counts.values()), F.lit(1.0)
    for y, n in counts.items():
        weight = F.when(F.col("label") == y, total / (len(counts) * n)).otherwise(weight)
    return df.withColumns({"unit": F.lit(1.0), "balanced": weight})


#: Rows of a task of a learner, about.
ROWS = 20_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many rows, in as many partitions as these need, whatever made them: learners pass over their rows up to
    thousands of times, and a task of few rows costs more than its rows do. Rows go by pair, so repeats deal them alike."""
    return df.repartition(max(1, ceil(rows / ROWS)), "pair_id")


def vectors(df: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(df)


def folds(df: DataFrame, k: int = FOLDS) -> DataFrame:
    """fold in [0, k), dealt by hash of the pair within each label: stratified on average, without a sort."""
    return df.withColumn("fold", F.pmod(F.xxhash64("label", "pair_id"), F.lit(k)).cast("int"))


def _params(clf, settings: dict) -> list:
    return ParamGridBuilder().baseOn({clf.getParam(k): v for k, v in settings.items() if clf.hasParam(k)}).build()


def grid(clf, name: str, rows: int, trees: int | None = None) -> list:
    out = [{}]
    for k, vs in GRIDS[name].items():
        out = [x | {k: v} for x in out for v in vs]
    return [m for x in out for m in _params(clf, settings(x, rows, trees))]


def draws(clf, name: str, n: int, rows: int, trees: int | None = None, seed: int = SEED) -> list:
    r = np.random.default_rng(seed)
    return [m for _ in range(n) for m in _params(clf, settings({k: f(r) for k, f in DRAWS[name].items()}, rows, trees))]


def _path(train: DataFrame, test: DataFrame | None, n_features: int, make, least: int, step: int) -> tuple[list[int], list[tuple[int, float]]]:
    """Features of the column scaled that are left when the weakest have gone, step at a time, down to least; and for each
    number of features met the accuracy on test of the classifier fitted with them."""
    kept, curve = list(range(n_features)), []
    score = MulticlassClassificationEvaluator(metricName="accuracy")
    while True:
        select = VectorSlicer(inputCol="scaled", outputCol="selected", indices=kept)
        if test is None and len(kept) <= least:
            return kept, curve
        model = make(len(kept)).setFeaturesCol("selected").fit(select.transform(train))
        if test is not None:
            curve.append((len(kept), score.evaluate(model.transform(select.transform(test)))))
        weights = _weights(model) if len(kept) > least else None
        if weights is None:
            return kept, curve
        weakest = sorted(range(len(kept)), key=lambda i: (weights[i], kept[i]))[: min(step, len(kept) - least)]
        kept = [f for i, f in enumerate(kept) if i not in weakest]


class Elimination(Estimator):
    """Recursive elimination as a stage: the number of features is that of best cross-validated accuracy (of equal ones the
    smallest), where each fold eliminates on its own; then all rows eliminate down to it. The fitted stage has the curve: the
    mean accuracy for each number of features. Classifiers without importances keep all."""

    def __init__(self, make, n_features: int, least: int = KEEP, step: int = 2, k: int = 2, cross_validated: bool = True):
        super().__init__()
        self.make, self.n_features, self.least, self.step, self.k, self.cross_validated = make, n_features, min(least, n_features), step, k, cross_validated

    def _fit(self, df: DataFrame) -> VectorSlicer:
        # Only what trees and scores read stays in memory.
        data = folds(df, self.k).select("scaled", "label", "fold").cache()
        curves: dict[int, list[float]] = {}
        for i in range(self.k if self.cross_validated else 0):
            for n, accuracy in _path(data.filter(F.col("fold") != i), data.filter(F.col("fold") == i), self.n_features, self.make, self.least, self.step)[1]:
                curves.setdefault(n, []).append(accuracy)
        curve = [(n, float(np.mean(a))) for n, a in curves.items()]
        target = min((n for n, a in curve if a == max(a for _, a in curve)), default=self.least)
        kept, _ = _path(data, None, self.n_features, self.make, target, self.step)
        data.unpersist()
        slicer = VectorSlicer(inputCol="scaled", outputCol="selected", indices=kept)
        slicer.curve = curve
        return slicer


def tune(train: DataFrame, names: list[str], name: str, search: str = "randomized", iterations: int = 10, k: int = FOLDS, parallelism: int = 4, keep: int | None = None, trees: int | None = None, step: int = 2):
    """The best setting of one classifier by cross-validated accuracy: settings, accuracy, pipeline fitted with them on all
    of train, the features that it uses and the curve of their elimination.

    With keep, features are first eliminated with the classifier's own settings, down to keep at least; the search then
    tries settings on what is left."""
    rows, own = train.count(), None
    prepare = [VectorAssembler(inputCols=names, outputCol="features"), MinMaxScaler(inputCol="features", outputCol="scaled")]
    if keep is not None and keep < len(names):
        own = Elimination(lambda n: classifiers(n, trees, rows)[name], len(names), keep, step)
    prepared = Pipeline(stages=[*prepare, *([own] if own else [])]).fit(train)
    kept = used(prepared, names)
    clf = classifiers(len(kept), trees, rows)[name].setFeaturesCol("selected" if own else "scaled")
    maps = grid(clf, name, rows, trees) if search == "grid" else draws(clf, name, iterations, rows, trees)
    cv = CrossValidator(estimator=clf, estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=k, foldCol="fold", parallelism=parallelism, seed=SEED)
    data = folds(weighed(prepared.transform(packed(train, rows))), k).cache()
    model = cv.fit(data)
    data.unpersist()
    at = int(np.argmax(model.avgMetrics))
    return {
        "classifier": name, "params": {p.name: v for p, v in maps[at].items()}, "cv_score": float(model.avgMetrics[at]),
        "model": PipelineModel([*prepared.stages, model.bestModel]), "features": kept, "curve": getattr(prepared.stages[-1], "curve", []),
    }


def used(model: PipelineModel, names: list[str]) -> list[str]:
    """The features that reach a pipeline's classifier."""
    return [names[i] for s in model.stages if isinstance(s, VectorSlicer) for i in s.getIndices()] or names


def perform_cv(train: DataFrame, names: list[str], algorithms=("all",), iterations: int = 10, k: int = FOLDS, parallelism: int = 4, keep: int | None = KEEP, trees: int | None = None) -> tuple[dict, list[dict]]:
    """The best of several classifiers, each scaled, its features eliminated by cross-validated accuracy down to keep at
    least, and tuned; and what was found for each."""
    found = [tune(train, names, n, "randomized", iterations, k, parallelism, keep, trees) for n in chosen(list(algorithms), len(names), trees)]
    return max(found, key=lambda x: x["cv_score"]), found


def importance(model: PipelineModel, names: list[str]) -> list[float] | None:
    """Importances or absolute coefficients of a pipeline's classifier; None if it has neither."""
    return _weights(model.stages[-1])


def _weights(last) -> list[float] | None:
    if hasattr(last, "featureImportances"):
        return last.featureImportances.toArray().tolist()
    return np.abs(last.coefficients.toArray()).tolist() if hasattr(last, "coefficients") else None


def fit(train: DataFrame, names: list[str], clf, standardize: bool = True, polynomial: bool = False) -> PipelineModel:
    stages = [VectorAssembler(inputCols=names, outputCol="features")]
    col = "features"
    if polynomial:
        stages.append(PolynomialExpansion(degree=3, inputCol=col, outputCol="poly"))
        col = "poly"
    if standardize:
        stages.append(MinMaxScaler(inputCol=col, outputCol="scaled"))
        col = "scaled"
    return Pipeline(stages=[*stages, clf.copy().setFeaturesCol(col)]).fit(train)


def eliminate(train: DataFrame, names: list[str], name: str, least: int = KEEP, step: int = 2, k: int = FOLDS, cross_validated: bool = True, trees: int | None = None) -> tuple[list[str], list[tuple[int, float]]]:
    """The features that elimination leaves, and its curve (see Elimination)."""
    rows = train.count() if name == "lsvm" else None
    stages = [VectorAssembler(inputCols=names, outputCol="features"), MinMaxScaler(inputCol="features", outputCol="scaled")]
    model = Pipeline(stages=[*stages, Elimination(lambda n: classifiers(n, trees, rows)[name], len(names), least, step, k, cross_validated)]).fit(train)
    return used(model, names), model.stages[-1].curve


def strongest(train: DataFrame, names: list[str], name: str, n: int = 12, trees: int | None = None) -> list[str]:
    """The n features of most importance to one fit."""
    weights = importance(fit(train, names, classifiers(len(names), trees)[name]), names)
    return names if weights is None else [f for _, f in sorted(zip(weights, names, strict=True), reverse=True)[:n]]


def train_and_eval(train: DataFrame, test: DataFrame, names: list[str], algorithms=("all",), trees: int | None = None, models: dict[str, PipelineModel] | None = None) -> tuple[DataFrame, DataFrame]:
    """Quality by classifier on test, and the decisions: classifier, pair_id (and row, if test has it), label, predicted.

    models are pipelines fitted before, by tune() say; without them each classifier is fitted with its own settings."""
    if models is None:
        rows = train.count()
        models = {name: fit(packed(train, rows), names, clf) for name, clf in chosen(list(algorithms), len(names), trees, rows).items()}
    out = None
    for name, model in models.items():
        one = model.transform(test).select(F.lit(name).alias("classifier"), "pair_id", *(c for c in ("row",) if c in test.columns), "label", (F.col("prediction") > 0).alias("predicted"))
        out = one if out is None else out.unionByName(one)
    return ratios(counted(out, "classifier"), missing=0.0), out


def top_importances(spark, model: PipelineModel, names: list[str], n: int = 50) -> DataFrame:
    weights = importance(model, names) or []
    return spark.createDataFrame([(f, float(w)) for f, w in zip(names, weights, strict=False)], "feature string, importance double").filter("importance <> 0").orderBy(F.desc("importance"), "feature").limit(n)


def ranking(df: DataFrame, value: str) -> DataFrame:
    """value scaled to [0, 1] over all rows, to two places. Its ends are one row, found by an aggregate."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or high == low:
        return df.withColumn("rank", F.lit(0.0))
    return df.withColumn("rank", F.bround(F.coalesce((F.col(value) - low) / (high - low), F.lit(0.0)), 2))
