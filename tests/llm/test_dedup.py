import random

import pytest

import corpus_pipeline
from kindred.llm import dedup

from .helpers import ODD, documents


def brute(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    """Groups of near copies whose members differ from each other by more than from their origin, copies, and a shared passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(12):
        origin = [word() for _ in range(r.randint(60, 160))] + passage
        for _ in range(r.randint(1, 14)):
            copy = list(origin)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    r.shuffle(rows)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(rows)]
    want = brute(rows)
    out = dedup.link(documents(spark, rows).repartition(3)).collect()
    assert len(out) == len(rows)
    for x in out:
        assert (x.n_shingles, x.component_id) == want[x.doc_id] and x.kept == (x.doc_id == x.component_id)
    kept = dedup.deduplicated(documents(spark, rows))
    assert kept.columns == documents(spark).columns and {x.doc_id for x in kept.collect()} == {c for _, c in want.values()}


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    r = random.Random(5)
    base = [str(r.random()) for _ in range(300)]
    rows = []
    for i in range(30):
        t = list(base)
        for _ in range(i % 7):
            t[r.randrange(300)] = str(r.random())
        rows.append((i, " ".join(t), "en", "s", 0))
    monkeypatch.setattr(dedup, "BLOCK", 4)
    want = brute(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in dedup.link(documents(spark, rows)).collect()} == want


def test_rows_that_share_an_id_and_differ_in_text(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    a, b, c = ([word() for _ in range(120)] for _ in range(3))
    near = lambda t: " ".join([*t[:60], "new", *t[61:]])
    rows = [(7, " ".join(a), "en", "s", 0), (7, " ".join(b), "en", "s", 0), (9, near(b), "en", "s", 0), (8, near(a), "en", "s", 0), (8, " ".join(c), "en", "s", 0), (9, near(c), "en", "s", 0), (7, near(b), "en", "s", 0)]
    for order in (rows, rows[::-1]):
        out = dedup.link(documents(spark, order).repartition(3)).collect()
        assert sorted((x.doc_id, x.component_id) for x in out) == [(7, 7), (7, 7), (7, 7), (8, 7), (8, 8), (9, 7), (9, 8)]
        kept = [(x.doc_id, x.text) for x in dedup.deduplicated(documents(spark, order)).collect()]
        # One of each group: a's, b's and c's, of the smallest id.
        assert sorted(i for i, _ in kept) == [7, 7, 8] and (8, " ".join(c)) in kept and (7, " ".join(a)) in kept


def test_odd_rows(spark):
    out = dedup.link(documents(spark)).collect()
    assert len(out) == len(ODD)
    by = {(x.doc_id, x.n_shingles): x for x in out}
    assert by[1, 0].kept and by[2, 0].component_id == 2 and by[6, 0].kept and by[5, 3].component_id == 4 and not by[5, 3].kept
    kept = dedup.deduplicated(documents(spark)).collect()
    assert sorted(str(x.doc_id) for x in kept) == ["1", "2", "3", "4", "6", "7", "None", "None"]
    assert dedup.link(documents(spark, [])).collect() == [] and dedup.deduplicated(documents(spark, [])).collect() == []


def test_pipeline_links_from_80_percent(spark):
    """Pairs on both sides of 0.8 and of 0.85, against brute force: the stage drops from 0.8 up, op3 links from 0.85 up."""
    r = random.Random(8)
    rows, want = [], {80: set(), 85: set()}
    for i in range(120):
        base = [str(r.random()) for _ in range(r.randint(150, 250))]
        copy = list(base)
        # A changed word far from the others changes five shingles of each text.
        for at in range(8, len(base) - 8, r.choice((40, 47, 54, 75))):
            copy[at] = str(r.random())
        rows += [(2 * i, " ".join(base), "en", "s", 0), (2 * i + 1, " ".join(copy), "en", "s", 0)]
        x, y = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (base, copy))
        for percent, dropped in want.items():
            if 100 * len(x & y) >= percent * len(x | y):
                dropped.add(2 * i + 1)
    assert want[85] and len(want[80] - want[85]) > 20 and len(want[80]) < 120
    docs, every = documents(spark, rows), {x[0] for x in rows}
    assert every - {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == want[80]
    assert {x.doc_id for x in dedup.link(docs).filter("NOT kept").collect()} == want[85]
    assert all(2 * x.chunks - 1 == x.errors and x.values <= len(dedup.FACTORS) for x in (dedup.AT_85, dedup.AT_80))
