"""Blocked pairs against all pairs."""

import random

import pytest

from kindred.functions import metrics
from kindred.operators import blocking


def made(seed: int = 6) -> list[str | None]:
    r = random.Random(seed)
    words = ["red", "hill", "hills", "old", "town", "tower", "bay", "é", "a", "aa", "port"]
    return [" ".join(r.choice(words) for _ in range(r.randrange(5))) for _ in range(150)] + ["", "x", "x", None, "a" * 80, "a" * 79 + "b", "Red Hill", "red hill"]


@pytest.mark.parametrize(("least", "block"), [(0.4, 500), (0.6, 7), (0.8, 3), (1.0, 500)])
def test_blocked_pairs_are_all_pairs_that_are_alike(spark, monkeypatch, least, block):
    monkeypatch.setattr(blocking, "BLOCK", block)
    strings = sorted({s for s in made() if s is not None})
    want = {(a, b): metrics.jaccard(a, b) for i, a in enumerate(strings) for b in strings[i + 1 :]}
    df = spark.createDataFrame([(i, s) for i, s in enumerate(made())], "gram int, s string").repartition(3)
    got = blocking.pairs_alike(df, least)
    rows = got.collect()
    assert len(rows) == len({(r.s1, r.s2) for r in rows})
    assert {(r.s1, r.s2): r.score for r in rows} == {k: v for k, v in want.items() if v >= least}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blocked_pairs_of_nothing(spark):
    assert blocking.pairs_alike(spark.createDataFrame([], "s string"), 0.5).collect() == []
    with pytest.raises(ValueError, match="least"):
        blocking.pairs_alike(spark.createDataFrame([], "s string"), 0.0)
