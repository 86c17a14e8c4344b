"""Trees and perceptron grown and fitted over partitions, against plain loops on small tables."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from kindred import params
from kindred.operators import extra_trees, ml
from kindred.operators.extra_trees import ExtraTrees
from kindred.operators.perceptron import Perceptron, Shape, penalised_loss
from kindred.plans import catalog


def table(spark, n=240, seed=4, parts=5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        y = float(r.random() < 0.4)
        rows.append((i, y, [y + r.gauss(0, 0.6), float(r.randrange(4)), 1.0, y * r.random(), r.random()]))
    df = spark.createDataFrame(rows, "pair_id long, label double, v array<double>").repartition(parts)
    return df.select("*", array_to_vector("v").alias("features")), rows


def plain_tree(x, y, tree, seed, drawn, least, depth, kind):
    """One tree by recursion over queues, a node at a time."""
    nodes = [{"rows": np.arange(len(x)), "split": None}]
    open_nodes = [(0, 0, 0)] if 0 < y.sum() < len(y) else []
    p = x.shape[1]
    while open_nodes:
        following = []
        for n, level, place in open_nodes:
            rows = nodes[n]["rows"]
            order = np.argsort([extra_trees.uniform(seed, np.array(tree), np.array(n), np.array(f), 1) for f in range(p)], kind="stable")
            best = None
            for f in [order[min(place + k, p - 1)] for k in range(drawn)]:
                low, high = x[rows, f].min(), x[rows, f].max()
                if high <= low:
                    continue
                t = low + (high - low) * float(extra_trees.uniform(seed, np.array(tree), np.array(n), np.array(f), 2))
                t = low if t >= high else t
                left, right = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                if min(len(left), len(right)) < least:
                    continue
                i = lambda part: len(part) * float(extra_trees.impurity(np.array(y[part].mean()), kind))
                gain = i(rows) - i(left) - i(right)
                if best is None or gain > best[0] + 1e-9:
                    best = gain, int(f), t, left, right
            if best is None:
                if place + drawn < p:
                    following.append((n, level, place + drawn))
                continue
            _, f, t, left, right = best
            nodes[n]["split"] = f, t, len(nodes)
            for part in (left, right):
                nodes.append({"rows": part, "split": None})
                if 0 < y[part].mean() < 1 and len(part) >= 2 * least and level + 1 < depth:
                    following.append((len(nodes) - 1, level + 1, 0))
        open_nodes = following
    return nodes


@pytest.mark.parametrize(("kind", "least", "depth"), [("gini", 1, 100), ("entropy", 4, 5)])
def test_extra_trees_are_those_of_a_plain_loop(spark, kind, least, depth):
    df, rows = table(spark)
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    est = ExtraTrees(numTrees=3, impurity=kind, minInstancesPerNode=least, maxDepth=depth, seed=7)
    model = est.fit(df)
    for t, tree in enumerate(model.trees):
        want = plain_tree(x, y, t, 7, 3, least, depth, kind)
        assert len(tree.feature) == len(want)
        for n, node in enumerate(want):
            assert (tree.feature[n], tree.child[n]) == ((node["split"][0], node["split"][2]) if node["split"] else (-1, -1))
            assert tree.weight[n] == len(node["rows"]) and tree.positive[n] == y[node["rows"]].sum()
            if node["split"]:
                assert tree.threshold[n] == pytest.approx(node["split"][1])
    again = est.fit(df.repartition(2))
    assert [t.arrays()[1].tolist() for t in again.trees] == [t.arrays()[1].tolist() for t in model.trees]
    assert model.featureImportances[2] == 0 and sum(model.featureImportances.toArray()) == pytest.approx(1)
    out = model.transform(df).select("label", "prediction", F.col("probability")).collect()
    assert sum(r.label == r.prediction for r in out) / len(out) > (0.99 if least == 1 else 0.8)


def test_extra_trees_of_few_rows(spark):
    df, _ = table(spark)
    for part in (df.filter("label = 1"), df.limit(0), df.limit(1)):
        model = ExtraTrees(numTrees=2).fit(part)
        assert all(len(t.feature) == 1 for t in model.trees) and model.transform(df).count() == df.count()


def test_gradient_by_differences(spark):
    """Loss and gradient over partitions are those over all rows; the gradient is that of differences."""
    df, rows = table(spark, 60)
    shape, alpha = Shape(5, 4), 1.0
    data = df.select(F.col("v").alias("x"), F.col("label").alias("y"))
    v = shape.start(1) + 0.05
    loss, g = penalised_loss(data, shape, v, alpha, len(rows))
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])

    def whole(u):
        w = shape.penalised(u)
        return shape.summed(u, x, y)[-1] / len(x) + alpha * (w @ w) / (2 * len(x))

    assert loss == pytest.approx(whole(v))
    for i in range(shape.size):
        e = np.zeros(shape.size)
        e[i] = 1e-6
        assert g[i] == pytest.approx((whole(v + e) - whole(v - e)) / 2e-6, abs=1e-5)


def test_perceptron_learns_and_is_penalised(spark):
    df, _ = table(spark, 200)
    model = Perceptron(hidden=8, alpha=0.1, maxIter=30).fit(df)
    assert all(a >= b for a, b in zip(model.losses, model.losses[1:], strict=False)) and model.losses[-1] < 0.5 * model.losses[0]
    stiff = Perceptron(hidden=8, alpha=1000.0, maxIter=15).fit(df)
    size = lambda m: float(np.square(m.shape.penalised(m.weights)).sum())
    assert size(stiff) < 0.1 * size(model)
    out = model.transform(df).collect()
    assert sum(r.label == r.prediction for r in out) / len(out) > 0.8
    for solver in ("adam", "gd"):
        losses = Perceptron(hidden=4, solver=solver, maxIter=6, stepSize=0.05).fit(df).losses
        assert len(losses) == 6 and losses[-1] < losses[0]
    assert Perceptron(hidden=2).fit(df.limit(0)).losses == []


def test_learners_are_tuned_like_the_others(spark):
    df, _ = table(spark, 120)
    df = df.select("pair_id", "label", *(F.col("v")[i].alias(f"f{i}") for i in range(5)))
    names = [f"f{i}" for i in range(5)]
    assert isinstance(ml.classifiers(5)["et"], ExtraTrees) and isinstance(ml.classifiers(5)["nn"], Perceptron)
    found = ml.tune(df, names, "et", iterations=1, k=2, trees=2)
    assert found["cv_score"] > 0.6 and ml.train_and_eval(df, df, names, models={"et": found["model"]})[1].count() == 120
    assert ml.top_importances(spark, found["model"], names).count() > 0


def test_the_perceptrons_query_has_all_steps_and_features(spark, monkeypatch):
    """F2 of round 4: ten steps on two of five groups of features."""
    met = {}

    def train_and_eval(train, test, names, algorithms, trees):
        met.update(names=names, columns=train.columns, steps=ml.classifiers(len(names), trees)[algorithms[0]].getMaxIter())
        return train, test

    monkeypatch.setattr(ml, "train_and_eval", train_and_eval)
    catalog.queries()["ml_nn"](spark, "/root/testdata/sf0.001").unpersist()
    assert met["names"] == params.feature_names() and len(met["names"]) == 85 and set(met["names"]) < set(met["columns"]) and met["steps"] == 200
