import re

from kindred.llm import licenses

from .helpers import ODD, documents

TEXTS = [
    "Released under the MIT License. And again: UNDER THE\nMIT  license!",
    "Apache License, Version 2.0 applies",
    "under the mit",
    "CC BY-NC 4.0 cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3.",
    "This work is truly licensed under some GNU General Public License, version 3.",
    "x " * 3000 + "licensed under the mozilla public license version 2 0" + " y" * 3000,
    "the the the under mit",
]


def brute(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    return len(ws), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_base_and_join(spark):
    rows = [(100 + i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]
    out = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    for i, t in enumerate(TEXTS):
        r = out[100 + i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "gpl-3" in out[104].labels and "gpl-3" in out[105].labels and "mpl-2" in out[106].labels
    assert out[102].score == 0 and out[107].labels == ""


def test_wrapped_notices(spark):
    """Notices wrapped at each of their words are found as on one line, within other words too."""
    rows, want = [], []
    for t, label in licenses.TEMPLATES.items():
        ws = t.split(" ")
        for cut in range(1, len(ws)):
            for around in ("", "other words here\n" * 20):
                rows.append((len(rows), around + " ".join(ws[:cut]) + "\r\n * " + " ".join(ws[cut:]) + "\n" + around, "en", "s", 0))
                want.append(label)
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published"
    rows, want = [*rows, (len(rows), gpl, "en", "s", 0)], [*want, "gpl"]
    out = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert all(label in out[i].labels.split(",") and out[i].score == 1 for i, label in enumerate(want))


def test_odd_rows(spark):
    out = licenses.scan(documents(spark)).collect()
    assert len(out) == len(ODD) and all(r.labels == "" and r.score == 0 for r in out)
    assert licenses.scan(documents(spark, [])).collect() == []


def test_no_python(spark):
    plan = licenses.scan(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
