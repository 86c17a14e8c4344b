"""Other scripts, stop-words by language and names in SQL."""

import pytest
from pyspark.sql import functions as F

from kindred import cli, params
from kindred.functions import metrics, register, terms, text
from kindred.operators import profile


@pytest.mark.parametrize(
    ("s", "want"),
    [
        ("Zürich ŁÓDŹ Straße", "zurich lodz strasse"), ("Αθήνα", "athena"), ("Москва Йошкар", "moskva ioshkar"), ("서울 한국", "seoul hangug"), ("부산", "busan"),
        ("ひらがな", "hiragana"), ("トウキヤウ", "toukiyau"), ("がぎ", "gagi"), ("თბილისი", "tbilisi"), ("Արաքս", "araks"), ("שלום", "shlvm"), ("بيروت", "byrwt"), ("٣٤ km", "34 km"), ("東京", "東京"), ("e\u0301", "e"), ("", ""),
    ],
)
def test_scripts(s, want):
    assert text.transliterated(s) == want


def test_stop_words_tell_languages_and_are_left_out(spark, tmp_path, capsys):
    rows = [("en", f"the town of x{i} and the hill") for i in range(30)] + [("fr", f"la ville de y{i} et la colline") for i in range(30)] + [("fr", "and"), (None, "the la"), ("de", None)]
    (tmp_path / "t").write_text("\n".join(f"{lang}\t{t}" for lang, t in rows if lang and t))
    lists = profile.lists_of(profile.stop_words(spark.createDataFrame(rows, "lang string, text string"), n=4))
    assert lists == {"en": ["and", "hill", "of", "the"], "fr": ["colline", "de", "et", "la"]}
    df = spark.createDataFrame([("The view of the bay",), ("La baie de Nice",), ("Bay 10",), (None,)], "s string")
    got = df.select(text.language(F.col("s"), lists).alias("l"), text.normalized(F.col("s"), lists, sort=True).alias("n"), text.normalized(F.col("s"), ["bay"]).alias("m")).collect()
    assert [r.l for r in got] == ["en", "fr", "english", "english"]
    assert [(r.n.kept, r.n.stopped) for r in got[:3]] == [(["bay", "view"], ["of", "the", "the"]), (["baie", "nice"], ["de", "la"]), (["bay"], [])]
    assert got[2].m.stopped == ["bay"] and got[2].m.kept == []
    cli.main(["-d", str(tmp_path / "t"), "--learn-stop-words", "--output", str(tmp_path / "o")])
    (tmp_path / "p").write_text("the bay\tla baie\tTRUE\t1\t2\tLATIN\tLATIN\tGR\tGR\n")
    cli.main(["-d", str(tmp_path / "p"), "--test", "2", "--stop-words", str(tmp_path / "o" / "stop_words"), "--output", str(tmp_path / "g")])
    grams = {r.gram for r in spark.read.schema("gram string, n long, kind string").option("sep", "\t").csv(str(tmp_path / "g" / "grams")).filter("kind = 'gram_token'").collect()}
    assert grams == {"bay", "baie"}


def test_names_in_sql(spark):
    names = register.register(spark, frequent=["port"])
    assert set(metrics.METRICS) < set(names) and len(names) == len(metrics.METRICS) + 2 * len(params.TERM_METRICS) + 1
    spark.createDataFrame([("old port", "port old"), ("mill town", "mil town"), (None, "x")], "a string, b string").createOrReplaceTempView("named_pairs")
    rows = spark.sql("SELECT a, b, jaro(a, b) AS j, avg_lsim_cosine(a, b) AS l, t.* FROM named_pairs, LATERAL term_split(a, b, 0.55) AS t").collect()
    assert len(rows) == 2
    for r in rows:
        assert r.j == metrics.jaro(r.a, r.b) and r.l == pytest.approx(terms.lsimilarity(r.a, r.b, "cosine", True, frequent=frozenset(["port"])))
        assert [r[c] for c in register.COLUMNS] == [",".join(side) for g in terms.split_terms(r.a, r.b, 0.55, frozenset(["port"])) for side in g]
    assert spark.sql("SELECT jaro(a, b) AS j FROM named_pairs WHERE a IS NULL").first().j is None
    with pytest.raises(ValueError, match="profile"):
        register.register(spark, profile="none")
