"""What keeps the pair queries in step with their input: pairs dealt out, scored in batches and once each."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from kindred.functions import grams, text
from kindred.operators import compare, evaluate, features, ml
from kindred.plans import fixtures
from kindred.sources import files

SMALL = "/root/testdata/sf0.001"


def test_stepped_pairs_are_dealt_by_number(spark, monkeypatch):
    """Few bytes of parts make many pairs: as many tasks score them as their number asks for."""
    monkeypatch.setattr(fixtures, "DEALT", 100)
    pairs = fixtures.stepped_pairs(spark, SMALL)
    parts = fixtures.table(spark, SMALL, "part").count()
    assert pairs.rdd.getNumPartitions() == -(-parts * fixtures.STEPS // 100) > 1
    k = [r.p_partkey for r in fixtures.table(spark, SMALL, "part").collect()]
    assert sorted((r.k1, r.k2) for r in pairs.collect()) == sorted((x, x + d) for x in k for d in range(1, fixtures.STEPS + 1) if x + d in k)


def test_gram_metrics_are_scored_in_batches(spark):
    """The scores are those of the expressions, and none of these is left in the plan."""
    df = spark.createDataFrame([("old town", "town old"), ("aaaa aaa", "aa aaa"), ("", ""), ("x", ""), (None, "a"), ("plate small", "small plate small")], "a string, b string")
    own = {"jaccard": grams.jaccard, "strike_a_match": grams.strike_a_match, "cosine": grams.cosine, "skipgram": grams.skipgram}
    out = evaluate.scored(df, own)
    assert "lambda" not in out._jdf.queryExecution().toString()
    whole = df.filter("a IS NOT NULL")
    assert [tuple(r[m] for m in own) for r in out.filter("a IS NOT NULL").collect()] == [tuple(r) for r in whole.select(*(f(F.col("a"), F.col("b")) for f in own.values())).collect()]
    assert all(r[m] is None for r in out.filter("a IS NULL").collect() for m in own)


@pytest.mark.parametrize("sorting", [False, True])
def test_repeated_pairs_are_scored_once_and_counted_each(spark, sorting):
    pairs = [("old town", "town old", "TRUE"), ("old town", "town old", "true"), ("old town", "town old", "FALSE"), ("red hill", "red hills", "TRUE"), ("low road", "main road", "no"), (None, "x", "TRUE")]
    df = spark.createDataFrame([p for i, p in enumerate(pairs) for _ in range(3 * i + 1)], "s1 string, s2 string, res string")
    once = evaluate.repeated(df)
    assert sorted((r.s1 or "", r.label, r.rows) for r in once.collect()) == [("", 1.0, 16), ("low road", 0.0, 13), ("old town", 0.0, 7), ("old town", 1.0, 5), ("red hill", 1.0, 10)]
    names = ("jaccard", "jaro")
    at = {r.method: r.thres for r in evaluate.threshold_table(spark, "sorted" if sorting else "orig").collect()}
    scores = evaluate.scored(evaluate.transformed(df, sorting), names).collect()
    for r in evaluate.evaluate_metrics(df, sorting, names=names).filter(F.col("method").isin(*names)).collect():
        said = [(x.res.upper() == "TRUE", x[r.method] >= at[r.method]) for x in scores if x[r.method] is not None]
        assert (r.tp, r.fn, r.fp, r.tn) == tuple(said.count(k) for k in ((True, True), (True, False), (False, True), (False, False)))


def test_features_are_one_python_stage(spark):
    """All groups, sorted again and again as they are, take one Python process a core."""
    df = spark.createDataFrame([("old town", "town old", "TRUE"), ("b10 a b9", "z q 007", "no"), (None, "a", "no")], "s1 string, s2 string, res string")
    out = features.build(df, frequent=["old"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    third = df
    for _ in range(3):
        third = evaluate.transformed(third, True, simple_sorting=False).select(F.col("a").alias("s1"), F.col("b").alias("s2"), "res")
    assert [(r.stat__tokens_s1, r.stat__tokens_s2) for r in out.collect()] == [tuple(r) for r in third.select(text.n_tokens(F.col("s1")).cast("double"), text.n_tokens(F.col("s2")).cast("double")).collect()]


def test_tokens_in_natural_order_in_python_as_in_spark(spark):
    words = ["b10", "b9", "a", "", "007", "7", "07", "07b", "0", "00", "a-1", "a-", "a1", "ab", "é", "a\x00", "a\x01b", "a\x02", "\x00", "10a2", "10a10", "9999999999999999999999", "\U0001f600"]
    r = random.Random(2)
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(12))) for _ in range(400)] + [" ", "", "  a ", "b a"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    plain = F.array_join(F.transform(F.array_sort(F.transform(text.split_spaces(F.col("s")), lambda t: F.struct(text.natural_key(t).alias("k"), t.alias("t")))), lambda x: x["t"]), " ")
    rows = df.select("s", text.sorted_text(F.col("s")).alias("got"), plain.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] == [text.naturally_sorted(r.s) for r in rows]


def test_learners_rows_are_packed(spark, monkeypatch):
    """Few rows over many partitions are one task for a learner; many are as many tasks as they ask for."""
    df = spark.range(600).select(F.col("id").alias("pair_id"), F.pmod("id", F.lit(2)).cast("double").alias("label"), F.rand(1).alias("x")).repartition(40)
    assert ml.packed(df, 600).rdd.getNumPartitions() == 1
    seen, fit = [], ml.fit
    monkeypatch.setattr(ml, "fit", lambda train, *a: seen.append(train.rdd.getNumPartitions()) or fit(train, *a))
    assert ml.train_and_eval(df, df, ["x"], ["nb"])[1].count() == 600 and seen == [1]
    monkeypatch.setattr(ml, "ROWS", 100)
    assert ml.packed(df, 600).rdd.getNumPartitions() == 6


def test_tokens_without_digits_sort_as_they_are(spark):
    """Sorting compares strings, no arrays of parts a token by an interpreted comparison."""
    plan = spark.createDataFrame([("b a",)], "s string").select(text.sorted_text(F.col("s")))._jdf.queryExecution().toString()
    assert "sort_array" in plan and "array_sort" not in plan


def test_long_texts_reach_python_in_small_groups(spark):
    """No Arrow batch of thousands of whole texts; accents go as one character after another loses them."""
    texts = ["Ünter Crème brûlée 각 ﬁ", "plain", "", None, "é̂" * 50_000, "नमस्ते ́"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", text.strip_accents(F.col("s")).alias("got"), text.canonical(F.col("s")).alias("c"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    for r in df.collect():
        assert r.got == (None if r.s is None else "".join(c for c in unicodedata.normalize("NFD", r.s) if unicodedata.category(c) != "Mn"))
        assert r.c == (None if r.s is None else text.made_canonical(r.s))


def test_decisions_of_sorted_runs_are_made_in_batches(spark):
    """Neither gram metrics nor sorting leave interpreted comparisons to a run over many pairs."""
    df = spark.createDataFrame([(0, "b10 a b9", "a b9", "TRUE")], "row long, s1 string, s2 string, res string")
    out = evaluate.decisions(df, sorting=True, names=("jaccard", "strike_a_match", "cosine", "skipgram"))
    plan = out._jdf.queryExecution().toString()
    assert "array_sort" not in plan and "array_intersect" not in plan
    assert (out.first().a, out.first().b, out.first().strike_a_match) == ("a b9 b10", "a b9", "TRUE")


@pytest.mark.parametrize("terms", [False, True])
def test_equal_pairs_of_a_numbered_file_are_decided_once(spark, monkeypatch, terms):
    """Each row has its own pair's decisions, as without numbers; a repeated pair is scored once, also where a string is missing."""
    pairs = [("old town", "town old", "TRUE"), ("old town", "town old", "no"), ("town old", "old town", "true"), (None, "x", "TRUE"), ("", "x", "no"), ("b10 a b9", "a b9 b10", "TRUE")]
    rows = [(7 * i + k, *p) for i, p in enumerate(pairs) for k in range(i + 1)]
    df = spark.createDataFrame(rows, "row long, s1 string, s2 string, res string").repartition(3)
    decide = (lambda p: evaluate.term_decisions(p)) if terms else (lambda p: evaluate.decisions(p, sorting=True))
    want = dict(zip(pairs, decide(spark.createDataFrame(pairs, "s1 string, s2 string, res string").coalesce(1)).collect(), strict=True))
    seen, transformed = [], evaluate.transformed
    monkeypatch.setattr(evaluate, "transformed", lambda p, *a, **k: seen.append(p.count()) or transformed(p, *a, **k))
    got = decide(df)
    assert got.columns[:3] == ["row", "s1", "s2"] and seen == [5]
    assert {r.row: tuple(r) for r in got.collect()} == {k: (k, p[0], p[1], *want[tuple(p)]) for k, *p in rows}
    assert got.count() == len(rows)


def test_runs_are_read_once_to_be_compared(spark, tmp_path):
    """Decisions and transformed strings of the second run come from one pass over its file."""
    (tmp_path / "p").write_text("".join(f"{a}\t{b}\t{res}\t1\t2\tLATIN\tLATIN\tGR\tGR\n" for a, b, res in [("old town", "town old", "FALSE")] * 3))
    pairs, runs = files.read_pairs(spark, str(tmp_path / "p"), with_rows=True), []
    for sorting in (False, True):
        files.write_decisions(evaluate.decisions(pairs, sorting, names=("jaro",)), str(tmp_path / f"{sorting}"))
        runs.append(files.read_decisions(spark, str(tmp_path / f"{sorting}")))
    found = compare.runs_of(pairs, *runs, ["jaro"])
    assert found.columns == ["row", "metric", "s1", "s2", "res", "transformed_s1", "transformed_s2"]
    assert sorted(tuple(r) for r in found.collect()) == [(i, "jaro", "old town", "town old", "FALSE", "old town", "old town") for i in range(3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("csv" in x for x in plan.splitlines() if "Relation" in x) == 3
