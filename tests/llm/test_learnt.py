"""Toxicity and language: held-out accuracy on small made-up tables."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.llm import language, toxicity
from kindred.llm.common import held_out

from .helpers import ODD, documents

SYLLABLES = {"aa": "ka lo mi ne".split(), "bb": "sch tz ung pf".split()}


def made(n, seed=0):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = r.choice(["aa", "bb"])
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(2, 4))) for _ in range(r.randint(30, 90))]
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grobian", "lump" + r.choice("abcdef"), "fiesling"]))
        rows.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = made(400)
    y = spark.createDataFrame([*labels, (7, 1, None), (None, 1, 1), (3, 0, labels[3][2])], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    m = toxicity.train(docs, y)
    assert m.known
    out = toxicity.score(docs.select("doc_id", "text"), m).withColumn("h", held_out(F.col("doc_id"))).filter("h").collect()
    truth = {i: t for i, _, t in labels}
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in out) >= 0.95 * len(out)
    kept = toxicity.accepted(docs, y)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i, t in truth.items() if not t and i % 7 == 0}


def test_pairs_of_terms_count():
    """An exclusive or of two terms has no linear weights; products of vectors give it."""
    import numpy as np

    rows, y = [[0], [1], [0, 1], []] * 60, np.array([1, 1, 0, 0] * 60, float)
    bias, w, v = toxicity.fit(rows, y, 2, 0.5)
    z = toxicity.Machine({}, bias, w, v).logits([[0], [1], [0, 1], []])
    assert (z > 0).tolist() == [True, True, False, False]


def test_toxicity_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = toxicity.train(documents(spark), none)
    out = toxicity.score(documents(spark).select("doc_id", "text"), m).collect()
    assert len(out) == len(ODD) and all(0 <= r.score < 0.51 for r in out)
    assert toxicity.accepted(documents(spark, []), none).collect() == []


def test_language(spark):
    rows, _ = made(300)
    docs = documents(spark, [*rows, (1000, "ka lo 123", None, None, None), (1001, "12 34", "aa", None, None), (1002, None, "aa", None, None)])
    out = {r.doc_id: r for r in language.predict(docs.select("doc_id", "text"), language.train(docs)).collect()}
    truth = {r[0]: r[2] for r in rows}
    assert sum(out[i].prediction.lang_pred == t for i, t in truth.items()) >= 0.98 * len(truth)
    assert all(0 <= r.prediction.score <= 1 for r in out.values())
    assert out[1001].prediction.lang_pred == out[1002].prediction.lang_pred == "und" and out[1000].prediction.lang_pred == "aa"


def test_language_odd_rows(spark):
    f = language.train(documents(spark, []))
    assert f.predict("text") == ("und", 0.0) and language.predict(documents(spark, []).select("text"), f).collect() == []
    assert language.predict(documents(spark).select("text"), language.train(documents(spark))).count() == len(ODD)


def test_false_positives_are_taken_off():
    import numpy as np

    r = np.random.default_rng(1)
    f = language.Filters({"x": r.integers(0, 2**63, 60_000), "y": r.integers(0, 2**63, 10)})
    assert 0 < f.false[0] < 0.05 and f.false[1] < 1e-12


@pytest.mark.parametrize("rule", ["one of two", "both", "insult with mention"])
def test_pairs_that_no_single_word_shows(spark, rule):
    """Toxicity that only pairs of words tell is learnt end to end: held out, nearly all are scored rightly."""
    import random

    r = random.Random(5)
    rows, labels = [], []
    for i in range(4000):
        ws = [f"w{r.randrange(400)}" for _ in range(12)]
        a, b = r.random() < 0.5, r.random() < 0.5
        ws += ["grumo"] * a + ["lintak"] * b
        r.shuffle(ws)
        toxic = {"one of two": a != b, "both": a and b, "insult with mention": a and b}[rule]
        if rule == "insult with mention" and r.random() < 0.25:
            ws, toxic = ws + ["zorvath"], True
        rows.append((i, " ".join(ws), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    m = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = toxicity.score(docs.filter(held_out(F.col("doc_id"))), m).select("doc_id", "score").collect()
    truth = {i: t for i, _, t in labels}
    assert len(out) > 700 and sum((x.score >= 0.5) == bool(truth[x.doc_id]) for x in out) / len(out) > 0.97
