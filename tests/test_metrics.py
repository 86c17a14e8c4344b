"""Micro-cases with values that can be worked out by hand, and native expressions against the kernels."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import grams, metrics, terms, text
from kindred.operators import evaluate
from kindred.plans import sql

CASES = [
    ("night", "nacht", 0.222222, 0.363636, 0.25, 0.363636),
    ("san jose", "jose san", 0.888889, 0.941176, 0.714286, 0.916667),
    ("athens", "athina", 0.238095, 0.384615, 0.4, 0.5),
    ("a", "a", 1.0, 1.0, 1.0, 1.0),
    ("a", "b", 0.0, 0.0, 0.0, 0.2),
    ("", "", 1.0, 1.0, 1.0, 1.0),
]


def test_gram_metrics(spark):
    names = ("jaccard", "cosine", "strike_a_match", "skipgram")
    df = spark.createDataFrame([c[:2] for c in CASES], "a string, b string")
    rows = evaluate.scored(df, names).collect()
    for r, c in zip(rows, CASES, strict=True):
        assert [r[n] for n in names] == pytest.approx(c[2:], abs=1e-6)
        assert [metrics.METRICS[n](*c[:2]) for n in names] == pytest.approx(c[2:], abs=1e-6)
    fixed = df.select(grams.skipgram(F.col("a"), F.col("b"), fixed=True).alias("s")).collect()
    assert [r.s for r in fixed] == pytest.approx([0.2, 0.769231, 0.333333, 1.0, 0.2, 1.0], abs=1e-6)


def test_edit_metrics():
    assert metrics.jaro("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6)
    assert metrics.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert metrics.jaro_winkler("abc", "abd") == pytest.approx(0.777778, abs=1e-6)
    assert metrics.osa_distance("ca", "abc") == 3 and metrics.osa_distance("ab", "ba") == 1
    assert metrics.damerau_levenshtein("", "") == 1.0 and metrics.jaro("", "") == 0.0 and metrics.soft_jaccard("", "") == 0.0


def test_token_metrics_add_up_as_sql_does():
    """Scores that are just a threshold in exact arithmetic fall on the side of SQL's plain sums, whatever a set's order is."""
    names = ["large anvil medium", "small gear medium", "blue anvil medium", "small plate medium", "small plate small", "old gear economy", "large ring promo", "hot bolt economy economy"]
    pairs = [(a, b) for a in names for b in names]
    con = duckdb.connect()
    con.execute("CREATE TABLE p (s1 VARCHAR, s2 VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", pairs)
    for m in ("monge_elkan", "soft_jaccard"):
        want = {(a, b): x for a, b, x in con.execute(f"SELECT s1, s2, {sql.METRICS[m]('s1', 's2')} FROM p").fetchall()}
        assert [metrics.METRICS[m](*p) for p in pairs] == [want[p] for p in pairs]
    assert metrics.monge_elkan(*names[:2]) < 0.7 and not metrics.batch("monge_elkan", names[:1], names[1:2])[0] >= 0.7


def test_tolerant_prefix():
    """One character left out on either side, or another one, still counts as a common start."""
    plain = lambda a, b: metrics._jaro(a, b, half=True)
    for a, b, k in (("abcdefgh", "axbcdefgh", 4), ("axbcdefgh", "abcdefgh", 4), ("abcdefgh", "axcdefgh", 5), ("abcdefgh", "abcdefgh", 4), ("abcd", "abxd", 2)):
        w = plain(a, b)
        assert metrics.l_jaro_winkler(a, b) == pytest.approx(w + 0.1 * k * (1 - w))
    assert metrics.l_jaro_winkler("abcdefgh", "abcdefgx", True) >= metrics.l_jaro_winkler("abcdefgh", "abcdefgx")


@settings(max_examples=200, deadline=None)
@given(st.text("abc -é", max_size=9), st.text("abc -é", max_size=9))
def test_bounds_identity_and_symmetry(a, b):
    for n, m in metrics.METRICS.items():
        assert -1e-9 <= m(a, b) <= 1 + 1e-9
        if all(a.split(" ")) and "-" not in a:  # an empty token is like nothing, not even itself
            assert m(a, a) == pytest.approx(1.0)
    for n in ("damerau_levenshtein", "cosine", "jaccard", "strike_a_match"):
        assert metrics.METRICS[n](a, b) == pytest.approx(metrics.METRICS[n](b, a))


def test_term_split_and_weights(spark):
    groups = terms.split_terms("athens north", "north athens", 0.9)
    assert groups == ((["north"], ["north"]), (["athens"], ["athens"]), ([], [])) or groups[0] == (["athens"], ["athens"])
    assert terms.split_terms("st mary church", "church of mary", 0.9, frozenset({"church"}))[2] == (["church"], ["church"])
    assert terms.calibrated_weights(((["a"], ["a"]), ([], []), ([], [])), (0.4, 0.5, 0.1), False) == [1.0, 0.0, 0.0]
    assert terms.calibrated_weights((([], []),) * 3, (0.4, 0.5, 0.1), True) is None and terms.lsimilarity("", "") == 1.0
    pairs = [("old town hall", "town hall old"), ("new bridge", "bridge"), ("", ""), ("a b", "c d")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.explode(terms.components_by_split(F.col("a"), F.col("b"), ["jaccard", "jaro_winkler_r"], [0.55])).alias("x")).select("a", "b", "x.*")
    for averaged in (False, True):
        for r in df.withColumn("w", terms.weighted(F.col("scores"), F.col("n"), F.col("chars"), F.col("same"), F.array(F.lit(0.4), F.lit(0.5), F.lit(0.1)), averaged)).collect():
            assert r.w == pytest.approx(terms.lsimilarity(r.a, r.b, r.metric, averaged, thres=0.55, weights=(0.4, 0.5, 0.1)))
    s = spark.createDataFrame(pairs, "a string, b string").select(terms.term_split(F.col("a"), F.col("b"), 0.55).alias("t")).collect()
    assert all(r.t.base.len == len(r.t.base.a) + len(r.t.base.b) for r in s)


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(text.canonical(lit("St.-Dénis Straße (Ωμέγα)"))) == "stdenis strasse (omega)"
    assert one(text.sorted_text(lit("b a 10 9"))) == "9 10 a b" and one(text.sorted_text(lit("a10 a9 -x 1"))) == "1 -x a9 a10"
    assert one(text.balanced_brackets(lit("[]()()(((([])))"))) is False and one(text.balanced_brackets(lit("[](){{{[]}}}"))) is True
    assert one(text.wordpunct_words(lit("L'Été, 12 abc1 Fin!"))) == ["l", "été", "fin"]
    assert one(text.detect_alphabet(lit("Москва city"))) == "CYRILLIC" and one(text.detect_alphabet(lit("12"))) == "UND"
    assert one(text.abbreviation(lit("the U.S. navy"))) == "U.S" and one(text.abbreviation(lit("none"))) == "-"
    assert one(text.has_dashed_words(lit("é-é"))) and not one(text.has_dashed_words(lit("- -")))
    assert one(text.contains_tokens(lit("ab c"), lit("xaby c"))) and one(text.n_tokens(lit("a b a"))) == 2
    assert one(text.frequent_flags(lit("b c"), ["a", "b"], 3)) == [False, True, False] and one(text.token_ngrams(F.array(lit("a"), lit("b")), 2)) == ["a b"]
    assert one(text.token_ngrams(F.array(lit("a")), 2)) == [] and one(text.thirds(lit("abcdef"))) == ["ab", "cd", "ef"]


def test_batches_equal_the_kernels():
    import random

    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcde é-.中") for _ in range(r.randint(0, n)))
    a = [word(r.choice([3, 12, 30, 200])) for _ in range(400)]
    b = [("".join(c for c in x if r.random() < 0.8) if r.random() < 0.6 else word(20)) for x in a]
    for name, own in metrics.METRICS.items():
        x, y = ([s[:14] for s in side[:60]] for side in (a, b)) if name == "permuted_winkler" else (a, b)
        assert metrics.batch(name, x, y) == pytest.approx([own(p, q) for p, q in zip(x, y, strict=True)], abs=1e-12), name
    assert metrics.batch("jaro", [], []).tolist() == []


def test_text_additions(spark):
    words = {"english": ["the", "of"], "german": ["der", "und"]}
    rows = spark.createDataFrame([("The town of the Lake", "b10 b9 b100000000000000000000000 b99999999999999999999999 9 10 a"), ("Haus der Tiere und Baum", "x"), ("Ort", "")], "s string, t string")
    out = rows.select(text.language(F.col("s"), words).alias("l"), text.stopped_words(F.col("s"), words["english"]).alias("w"), text.sorted_text(F.col("t")).alias("n")).collect()
    assert [r.l for r in out] == ["english", "german", "english"] and out[0].w == ["the", "of", "the"] and out[1].w == []
    assert out[0].n == "9 10 a b9 b10 b99999999999999999999999 b100000000000000000000000"
    deep = spark.createDataFrame([("([{" * 500 + "}])" * 500,), ("([)]",), (")(",), ("",), ("no brackets",)], "s string").select(text.balanced_brackets(F.col("s")).alias("b")).collect()
    assert [r.b for r in deep] == [True, False, False, True, True]
    assert rows.limit(1).select(text.distinct_in_order(F.split(F.lit("b a b c a"), " ")).alias("x")).first().x == ["b", "a", "c"]


def test_cosine_counts_repeated_grams(spark):
    pairs = [("banana banana", "banana"), ("aaaa", "aaab"), ("night", "nacht"), ("", ""), ("a", "b"), ("abcabcabc", "cabcab")]
    out = spark.createDataFrame(pairs, "a string, b string").select(grams.cosine(F.col("a"), F.col("b")).alias("x"), grams.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [r.x for r in out] == pytest.approx([metrics.cosine(a, b) for a, b in pairs]) and [r.j for r in out] == pytest.approx([metrics.jaccard(a, b) for a, b in pairs])
