"""Metrics and term similarities of whole batches against the kernels, pair by pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred import params
from kindred.functions import metrics, terms
from kindred.operators import sweep

WORDS = ["old", "town", "tow", "north", "port", "porto", "norte", "é", "ß", "aa", "aaaa", "lake", "lakes", "st.", "-", "x", "bridge", "bridgetown", "streat", ".", "a1", "a10", "ba"]


def made(n: int = 400) -> list[tuple[str, str]]:
    r = random.Random(3)
    phrase = lambda: " ".join(r.choice(WORDS) for _ in range(r.randrange(6)))
    letters = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(14)))
    odd = [("", ""), ("  ", " "), ("x", ""), ("a" * 300, "a" * 299 + "b"), ("x y", " x  y "), ("\U0001f600 a", "a \U0001f600")]
    return [(phrase(), phrase()) for _ in range(n)] + [(letters(), letters()) for _ in range(n)] + odd


@pytest.mark.parametrize("name", [m for m in metrics.METRICS if m != "permuted_winkler"])
def test_metrics_of_batches(name):
    a, b = map(list, zip(*made(), strict=True))
    assert metrics.batch(name, a, b).tolist() == [metrics.METRICS[name](x, y) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("known", [frozenset(), frozenset({"old", "st.", "a1", "lake"})])
def test_term_similarities_of_batches(known):
    """Splits are the kernel's, whatever the threshold; similarities differ by rounding of sums at most."""
    a, b = map(list, zip(*made(150), strict=True))
    splits = terms.Splits(a, b, known)
    for thres in (0.5, 0.75, 1.0):
        groups = splits.at(thres)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            assert [(tuple(g[0][i]), tuple(g[1][i])) for g in groups.terms] == [(tuple(p), tuple(q)) for p, q in terms.split_terms(x, y, thres, known)]
    specs = {f"{m} {averaged} {turned}": (m, averaged, turned) for m in params.TERM_METRICS for averaged in (False, True) for turned in (False, True)}
    for profile in params.PROFILES:
        got = terms.lsim_batch(a, b, specs, profile, known)
        for name, (m, averaged, turned) in specs.items():
            want = [terms.lsimilarity(x[::-1] if turned else x, y[::-1] if turned else y, m, averaged, profile, known) for x, y in zip(a, b, strict=True)]
            assert got[name] == pytest.approx(want, abs=1e-12), name


def test_scores_for_all_weights(spark):
    """One score for each set of weights, as the weighted sum of component scores gives it, and null strings as empty ones."""
    df = spark.createDataFrame([*made(40), (None, "x"), (None, None)], "a string, b string")
    weights = sweep.weight_grid()
    both = df.select(
        terms.scores_by_split(F.col("a"), F.col("b"), ["jaro", "jaro_winkler_r"], [0.5, 0.7], weights).alias("s"),
        terms.components_by_split(F.col("a"), F.col("b"), ["jaro", "jaro_winkler_r"], [0.5, 0.7]).alias("c"),
    ).select(F.explode(F.arrays_zip("s", "c")).alias("z")).select("z.s.scores", "z.c", F.col("z.s.metric") == F.col("z.c.metric"))
    score = lambda w: terms.weighted(F.col("c.scores"), F.col("c.n"), F.col("c.chars"), F.col("c.same"), F.array(*map(F.lit, w)))
    rows = both.select("scores", F.array(*map(score, weights)).alias("want")).collect()
    assert len(rows) == 4 * df.count() and all(r.scores == pytest.approx(r.want, abs=1e-12) for r in rows)


def test_histograms_equal_counting(spark):
    """Quality by threshold of a histogram is that of counting each score at each threshold; rows without a score count nowhere."""
    r = random.Random(8)
    rows = [(r.choice("xy"), float(r.randrange(2)), r.choice([None, 0.3, 0.5, 0.7, r.random()])) for _ in range(600)]
    thresholds = [0.7, 0.3, 0.5]
    got = sweep.by_threshold(spark.createDataFrame(rows, "method string, label double, score double"), thresholds, "method").collect()
    assert len(got) == 6
    for x in got:
        own = [(y > 0, s >= x.thres) for m, y, s in rows if m == x.method and s is not None]
        assert (x.tp, x.fn, x.fp, x.tn) == tuple(own.count(k) for k in ((True, True), (True, False), (False, True), (False, False)))
        assert np.isclose(x.accuracy, (x.tp + x.tn) / len(own))
