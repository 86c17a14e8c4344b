"""Phrases, fingerprints and divergence against DuckDB and plain loops, on odd rows and on none."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kindred.llm import divergence, fingerprints, phrases

from .helpers import ODD, documents, put

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed: int = 3, n: int = 160) -> list[tuple]:
    """Texts of few words, so that phrases repeat, in languages whose names are words too."""
    r = random.Random(seed)
    vocabulary = ["en", "es", "la", "Red", "hill", "côte", "Ünder", "ſ", "İ", "a b", "x-y", "__", "中文"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", ";", "\x0b", ":"]
    rows = []
    for i in range(n):
        text = "".join(r.choice(vocabulary[: 3 + i % 11]) + r.choice(ends) for _ in range(r.randrange(60)))
        rows.append((i, text, r.choice(["en", "es", None]), r.choice(["a", "b", "", None, "\U0001f600"]), 0))
    return rows + ODD + [(700, "en en en en en. en en", "es", "a", 0)] * 4 + [(701, "", "zz", "empty", 0), (702, "... 123", "yy", "b", 0)]


def oracle(path: str, query: str) -> list[tuple]:
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return sorted(db.sql(query).fetchall(), key=repr)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_collocations_and_divergence_equal_their_sql(spark, tmp_path):
    path = put(spark, tmp_path, documents=documents(spark, made()).repartition(5))
    got = rows_of(phrases.op11_mine_phrases(spark, path))
    assert got == oracle(path, phrases.OP11_SQL) and len({r[0] for r in got}) > 2
    got = rows_of(divergence.op13_source_divergence(spark, path))
    assert got == oracle(path, divergence.OP13_SQL) and {r[2] for r in got} == {"pair", "term"}
    assert any(r[0] == "yy" for r in oracle(path, "SELECT DISTINCT lang FROM documents")) and all(r[3] != r[1] for r in got if r[2] == "pair")


def test_collocations_by_a_plain_loop(spark):
    """Every phrase's count, whatever the counters' width, the automata's size and the number of rounds."""
    rows = made(5)
    counts = defaultdict(Counter)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for _, text, lang, _, _ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            ws = re.findall("[^\x20\x09]+", piece)
            for n in (2, 3):
                counts[lang or "und"].update(" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1))
    want = {(lang, p, n) for lang, c in counts.items() for p, n in c.items() if n >= 4}
    docs = spark.createDataFrame(rows, DOCS).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).repartition(3).cache()
    words = docs.mapInArrow(phrases._word_counts, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    kept = phrases.CELLS, phrases.ROUND, phrases.DIGITS, phrases.CHARACTERS
    try:
        for phrases.CELLS, phrases.ROUND, phrases.DIGITS, phrases.CHARACTERS in (((1 << 16, 1 << 27), 10**6, phrases.DIGITS, 10**6), ((1 << 16, 1 << 16), 40, ["0", "1"], 500)):
            assert {tuple(r) for r in phrases.phrase_counts(docs, words, 4).collect()} == want
    finally:
        phrases.CELLS, phrases.ROUND, phrases.DIGITS, phrases.CHARACTERS = kept
    assert any(p.split() == ["en"] * 3 for _, p, _ in want)


class Sent:
    def __init__(self, value):
        self.value = value


def test_counters_are_upper_bounds():
    """No phrase that occurs often enough is missed where far more phrases than counters meet; words marked as rare break phrases."""
    words = [str(i % 997) for i in range(60_000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(words)]})
    every, cells = np.full(4096, 255, np.uint8), 1 << 10
    parts = [r for b in phrases._sketched(Sent(every), cells, 10)(iter([batch])) for r in b.to_pylist()]
    assert {r["row"] for r in parts} == {0, 1} and all(max(r["counts"]) <= 10 for r in parts)
    for _, _, x in phrases.phrase_hashes(words, phrases.Hashes("en", every)):
        for row, cell in enumerate(phrases.cells_of(x, cells)):
            counts = np.zeros(phrases.BLOCK, np.uint8)
            for r in parts:
                if r["row"] == row:
                    counts[np.frombuffer(r["places"], "<u2")] = np.frombuffer(r["counts"], np.uint8)
            assert (counts[cell] == 10).all()
    assert not any(len(x) for _, _, x in phrases.phrase_hashes(words, phrases.Hashes("en", np.zeros(4096, np.uint8))))


def test_texts_are_read_twice_however_many_candidates_there_are(spark):
    """Once for the counters and once for the counts, in one row of counters and in two (F1 of round 4: a scan every ROUND candidates)."""
    rows, read = made(5), spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(rows, DOCS).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).repartition(3).cache()
    words = docs.mapInArrow(phrases._word_counts, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).cache()
    words.count()
    kept, found = (phrases.CELLS, phrases.ROUND), []
    try:
        for phrases.CELLS, phrases.ROUND in (((1, 1 << 40), 40), ((1 << 16, 1 << 40), 40), ((1, 1 << 40), 10**6)):
            before = read.value
            found.append({tuple(r) for r in phrases.phrase_counts(docs.mapInArrow(passed, docs.schema), words, 4).collect()})
            assert read.value - before == 2 * len(rows)
    finally:
        phrases.CELLS, phrases.ROUND = kept
    assert found[0] == found[1] == found[2] and len(found[0]) > 40


def test_counts_of_a_task_are_those_of_a_plain_loop(monkeypatch):
    """Whatever it numbers at a time, holds and passes on; in many languages, where numbers begin anew; and where no text has a phrase."""
    r = random.Random(8)
    texts = [(f"l{r.randrange(90)}", " ".join(r.choice(["ab", "c", "dé", "中", "E.", "f,"]) + str(r.randrange(6)) for _ in range(r.randrange(300)))) for _ in range(300)]
    want = Counter()
    for lang, text in [*texts, *texts]:
        for piece in re.split("[.,]", text.lower()):
            ws = piece.split()
            want.update((lang, " ".join(ws[i : i + n])) for n in (2, 3) for i in range(len(ws) - n + 1))
    batch = pa.RecordBatch.from_pydict({"lang": [x for x, _ in texts], "text": [t for _, t in texts]})
    every, cells = np.full(1 << 16, 255, np.uint8), 1 << 40
    for span, held, at_once in ((7, 3, 50), (10**6, 10**6, 10**6)):
        monkeypatch.setattr(phrases, "SPAN", span)
        monkeypatch.setattr(phrases, "HELD", held)
        monkeypatch.setattr(phrases, "ROUND", at_once)
        got = Counter()
        for b in phrases._candidates(Sent(every), Sent(every), cells)(iter([batch, batch])):
            for row in b.to_pylist():
                for p, n in zip(row["phrases"].split("\n"), np.frombuffer(row["counts"], "<u4").tolist(), strict=True):
                    got[row["lang"], p] += n
        assert got == want
    assert not list(phrases._candidates(Sent(every), Sent(every), cells)(iter([batch.slice(0, 0)])))
    few = {"lang": ["en"], "block": [3], "phrases": ["a b\nc d"], "counts": pa.array([np.array([1, 2], "<u4").tobytes()])}
    (none,) = phrases._united(10)(iter([pa.RecordBatch.from_pydict(few)]))
    assert none.num_rows == 0 and none.schema.field("lang").type == pa.string()


def plain_sketch(text: str | None, size: int = fingerprints.SIZE) -> list[int]:
    def of(ws):
        h = 42
        for w in ws:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h - 2**64 if h >= 2**63 else h

    ws = [w for w in re.split("[\x20\x09-\x0d]", (text or "").lower()) if w]
    return sorted({of(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {of(ws)} if ws else set())[:size]


def plain_likeness(a: list[int], b: list[int], size: int = fingerprints.SIZE) -> float:
    union = sorted({*a, *b})[:size]
    return len({*a} & {*b} & {*union}) / len(union) if union else 1.0


def test_fingerprints_by_a_plain_loop(spark, tmp_path):
    r = random.Random(1)
    rows = [(i * 7 % 101 - 50, " ".join(r.choice(["red", "Hill", "中文", "é", "of"]) for _ in range(r.randrange(400))), "en", "a", 0) for i in range(101)]
    rows += [(-(2**63), "the smallest id", "en", "a", 0), (2**63 - 1, None, "en", "a", 0), (2**53 + 1, "close", None, None, 0), (2**53, "ids", None, None, 0), (None, "no id", None, None, 0), (500, "w " * 30_000, "en", "b", 0)]
    path = put(spark, tmp_path, documents=documents(spark, rows).repartition(4))
    got = {r.doc_id: r for r in fingerprints.op12_fingerprint_documents(spark, path).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    digits = lambda s: "".join(f"{h % 2**64:016X}" for h in s)
    assert len(got) == len(rows)
    for k, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = map(plain_sketch, (text, edited, after))
        row = got[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == (digits(a), digits(b))
        assert (row.near_edited, row.near_next) == (plain_likeness(a, b), plain_likeness(a, c))


def test_fingerprints_of_odd_and_equal_rows(spark, tmp_path):
    path = put(spark, tmp_path / "odd", documents=documents(spark))
    got = fingerprints.op12_fingerprint_documents(spark, path).collect()
    assert len(got) == len(ODD)
    prints = defaultdict(set)
    for r in got:
        prints[r.doc_id].add(r.fingerprint)
    assert prints[4] == prints[5] and len(prints[4]) == 1 and prints[1] == prints[2] == {""}
    one = put(spark, tmp_path / "one", documents=documents(spark, ODD[5:6]))
    (row,) = fingerprints.op12_fingerprint_documents(spark, one).collect()
    assert row.near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    """Merged sketches are those of the union; estimates lie near exact sets' figures."""
    r = random.Random(2)
    base = [" ".join(r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(900)) for _ in range(4)]
    parts = [(f"k{i % 2}", t) for i, t in enumerate(base)] + [("k0", ""), ("none", None), (None, "only five words are here")]
    df = spark.createDataFrame(parts, "k string, text string").withColumn("s", fingerprints.sketch(F.col("text"), 64))
    got = {x.k: x.s for x in fingerprints.merged(df, "s", "k", size=64).collect()}
    for k in ("k0", "k1", "none", None):
        union = sorted({h for kk, t in parts if kk == k for h in plain_sketch(t, 10**6)})[:64]
        assert got[k] == union
    half = " ".join(base[0].split()[:450] + base[1].split()[450:])
    two = spark.createDataFrame([(base[0], half)], "x string, y string").select(fingerprints.sketch(F.col("x")).alias("a"), fingerprints.sketch(F.col("y")).alias("b"))
    row = two.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct(F.col("a")).alias("n")).first()
    a, b = (set(plain_sketch(t, 10**6)) for t in (base[0], half))
    assert row.j == pytest.approx(len(a & b) / len(a | b), abs=0.15) and row.c == pytest.approx(len(a & b) / len(a), abs=0.2) and row.n == pytest.approx(len(a), rel=0.3)
    plan = two._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_rows(spark, tmp_path):
    path = put(spark, tmp_path, documents=documents(spark, []))
    for query in (phrases.op11_mine_phrases, fingerprints.op12_fingerprint_documents, divergence.op13_source_divergence):
        assert query(spark, path).collect() == []
