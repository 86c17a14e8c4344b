import re

import pytest

from kindred.llm import mixing

from .helpers import ODD, documents


def reshared(sizes, weights=(3.0, 1.0, 2.0)):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while free and budget > 1e-9:
        total = sum(w[s] for s in free)
        for s in free:
            target[s] += budget * w[s] / total
        budget = 0.0
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                budget += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("seed", [0, 1])
def test_targets_and_taken(spark, seed):
    rows = [(i, " ".join(["w"] * ((i * 37 + seed) % 90)), "en", None if i % 11 == 0 else f"s{i % 7 if i % 3 else 0}", 0) for i in range(900)]
    out = mixing.mix(documents(spark, rows)).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    target, taken = reshared(sizes), dict.fromkeys(sizes, 0)
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 45 for s in sizes)


def test_odd_rows(spark):
    out = mixing.mix(documents(spark)).collect()
    assert len(out) == len(ODD) and all(0 <= r.taken <= 2 * r["size"] for r in out)
    again = mixing.mix(documents(spark).repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(documents(spark))
    assert mixed.columns == documents(spark).columns and mixed.count() == sum(r.copies for r in out)


def test_two_copies_at_most(spark):
    """Empty documents of a source at its limit are no more than twice in the mix, as its other documents are."""
    rows = [(i, "" if i % 2 else "w " * 3, "en", "small", 0) for i in range(40)] + [(100 + i, "w " * 50, "en", "zlarge", 0) for i in range(40)]
    out = mixing.mix(documents(spark, rows)).collect()
    assert {r.copies for r in out if r.source == "small"} == {2} and max(r.copies for r in out) <= 2
    assert mixing.mixed_documents(documents(spark, rows)).count() == sum(r.copies for r in out)


def test_empty(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    assert mixing.mixed_documents(documents(spark, [])).collect() == []
