"""Comparison of runs by row, against plain loops over the lines of the files."""

import random

import pytest
from pyspark.sql import functions as F

from kindred import cli, params
from kindred.operators import compare, evaluate
from kindred.sources import files

#: Pairs that sorting changes, one of them three times, names with blanks inside, and one of another script.
PAIRS = [("old town", "town old", "TRUE"), ("b a", "z q", "FALSE"), ("old town", "town old", "FALSE"), ("red hill", "hills red", "TRUE"), ("old town", "town old", "TRUE"), ("low  road", "main road", "FALSE"), ("green bay", "bay green lake", "FALSE")]


def line(a: str, b: str, res: str, alphabet: str = "LATIN") -> str:
    return f"{a}\t{b}\t{res}\t1\t2\t{alphabet}\tLATIN\tGR\tGR"


@pytest.fixture
def pair_file(tmp_path):
    path = tmp_path / "pairs.tsv"
    path.write_text("\n".join([*(line(*p) for p in PAIRS[:3]), "broken", *(line(*p, alphabet="GREEK" if i == 3 else "LATIN") for i, p in enumerate(PAIRS[3:]))]))
    return str(path)


#: Rows of the pairs: the broken line has a number, too.
ROWS = [0, 1, 2, 4, 5, 6, 7]


def test_rows_of_split_files(spark, tmp_path):
    """Numbers run on over the splits of files and over files, whatever the splits' size."""
    r = random.Random(4)
    folder = tmp_path / "many"
    folder.mkdir()
    lines = [f"{i}\t{'x' * r.randrange(200)}" for i in range(4000)]
    for k, (start, end) in enumerate(((0, 100), (100, 100), (100, 3900), (3900, 4000))):
        (folder / f"part-{k:05d}.csv").write_text("".join(x + "\n" for x in lines[start:end]))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("10k", "37k", kept):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = files.numbered(spark, str(folder), "i long, x string")
            assert got.filter("row <> i").count() == 0 and got.count() == 4000
            assert sorted(x.row for x in got.filter("x IS NULL").collect()) == [i for i, x in enumerate(lines) if x.endswith("\t")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_two_runs_by_row(spark, pair_file, tmp_path):
    """A run with sorting against one without: repeated and reordered pairs meet their own rows, as in a loop over lines."""
    pairs = files.read_pairs(spark, pair_file, with_rows=True)
    assert [r.row for r in pairs.orderBy("row").collect()] == ROWS
    for name, flags in (("plain", []), ("sorted", ["--sort"])):
        cli.main(["-d", pair_file, "--accuracyresults", "--output", str(tmp_path / name), *flags])
    first, second = (files.read_decisions(spark, str(tmp_path / p)) for p in ("plain/decisions", "sorted/decisions_sorted"))
    assert files.metrics_of(first) == list(params.EVALUATED) and files.metrics_of(second) == [*params.EVALUATED, *params.TERM_DECISIONS]
    one, two = ({r.row: r.asDict() for r in df.collect()} for df in (first, second))
    assert sorted(one) == sorted(two) == ROWS and [(one[k]["s1"], one[k]["s2"]) for k in ROWS] == [p[:2] for p in PAIRS]
    want = [(k, m, a, b, res) for k, (a, b, res) in zip(ROWS, PAIRS, strict=True) for m in params.EVALUATED if one[k][m] == res != two[k][m]]
    got = compare.runs_of(pairs, first.repartition(5), second.repartition(3), list(params.EVALUATED))
    assert sorted((r.row, r.metric, r.s1, r.s2, r.res) for r in got.collect()) == sorted(want) != []
    cli.main(["-d", f"{pair_file},{tmp_path}/plain/decisions,{tmp_path}/sorted/decisions_sorted", "--cmp", "--onlyLATIN", "--output", str(tmp_path / "c")])
    written = spark.read.schema("s1 string, s2 string, res string, x string, y string, metric string").option("sep", "\t").csv(str(tmp_path / "c" / "regressions"))
    # The last pair's first name is of another script.
    assert written.count() == sum(k != ROWS[-1] for k, *_ in want)


def test_plain_result_files_by_position(spark, pair_file, tmp_path):
    """Files without rows: a line a pair."""
    said = [(res, *("TRUE" if (i + k) % 2 else "FALSE" for k in range(14)), a, b) for i, (a, b, res) in enumerate(PAIRS)]
    (tmp_path / "run").write_text("\n".join("\t".join(x) for x in said))
    got = {r.row: r for r in files.read_decisions(spark, str(tmp_path / "run")).collect()}
    assert [(got[i].real, got[i].jaccard, got[i].a) for i in range(7)] == [(x[0], x[2], x[15]) for x in said]
    (tmp_path / "sorted").write_text("\n".join("\t".join((*x[:15], "TRUE", "FALSE", *x[15:])) for x in said))
    assert files.metrics_of(files.read_decisions(spark, str(tmp_path / "sorted"))) == [*params.EVALUATED, *params.TERM_DECISIONS]


@pytest.mark.parametrize("n", [7, 6])
def test_outcomes_in_halves(spark, tmp_path, n):
    """The second half of the outcomes stands first; false negatives and positives are those of each pair's own outcome."""
    pairs = [(f"a{i}", f"b{i}", "TRUE" if i % 2 else "FALSE") for i in range(n)]
    (tmp_path / "p").write_text("\n".join(line(*p) for p in pairs))
    own = [(p[2], "TRUE" if i % 3 else "FALSE") for i, p in enumerate(pairs)]
    # A file whose second half, put before its first, is in the pairs' order.
    half = n // 2
    stored = [None] * n
    for i in range(n):
        stored[(i + half) % n] = own[i]
    assert stored[half:] + stored[:half] == own
    (tmp_path / "o").write_text("\n".join("\t".join(x) for x in stored))
    cli.main(["-d", f"{tmp_path}/p,{tmp_path}/o", "--cmp", "--halves", "--output", str(tmp_path / "c")])
    for name, res in (("false_negatives", "TRUE"), ("false_positives", "FALSE")):
        got = spark.read.schema("s1 string, s2 string").option("sep", "\t").csv(str(tmp_path / "c" / name)).collect()
        assert sorted(r.s1 for r in got) == sorted(p[0] for p, (r1, r2) in zip(pairs, own, strict=True) if r1 == res != r2)


def test_classifiers_outcomes_are_compared(spark, tmp_path):
    pairs = [(f"x{i}", f"x{i if i % 2 else i + 1}", "TRUE" if i % 2 else "FALSE") for i in range(40)]
    (tmp_path / "p").write_text("\n".join(line(*p) for p in pairs))
    cli.main(["-d", f"{tmp_path}/p", "--ev", "SotAMetrics", "--accuracyresults", "--output", str(tmp_path / "o")])
    df = evaluate.decisions(files.read_pairs(spark, f"{tmp_path}/p", with_rows=True))
    out = df.select("row", (F.col("real") == "TRUE").alias("res1"), (F.col("jaro") == "TRUE").alias("res2"))
    files.write_tsv(out.repartition(4), str(tmp_path / "outcomes"), header=True)
    cli.main(["-d", f"{tmp_path}/p,{tmp_path}/outcomes", "--cmp", "--output", str(tmp_path / "c")])
    wrong = out.filter("res1 <> res2").count()
    assert wrong == sum(spark.read.text(str(tmp_path / "c" / k)).count() for k in ("false_negatives", "false_positives")) > 0


def test_wrong_number_of_files(pair_file, capsys):
    cli.main(["-d", pair_file, "--cmp"])
    assert "two or three" in capsys.readouterr().out
