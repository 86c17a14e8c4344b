"""Comparison of runs: rows of result files meet by their number in the file of pairs (or by another key)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def false_negatives_positives(results: DataFrame) -> DataFrame:
    """kind (FN or FP), s1 and s2 of pairs whose decision res2 differs from res1."""
    return results.filter(F.col("res1") != F.col("res2")).select(F.when(F.col("res1"), "FN").otherwise("FP").alias("kind"), "s1", "s2")


def latin_only(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a1 = 'LATIN' AND a2 = 'LATIN'")


def regressions(first: DataFrame, second: DataFrame, metrics: list[str], on: str = "pair_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """pair_id and metric where the first run decides rightly and the second wrongly, and columns to keep of the second."""
    wide = lambda df, side, *more: df.select(on, F.col("res").alias(f"res{side}"), *(F.col(m).alias(f"{m}__{side}") for m in metrics), *more)
    both = wide(first, 1).join(wide(second, 2, *keep), on)
    rows = both.select(on, "res1", "res2", *keep, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}__1").alias("d1"), F.col(f"{m}__2").alias("d2")) for m in metrics))).alias("x")).select(on, "res1", "res2", *keep, "x.*")
    return rows.filter("res1 = d1 AND res2 <> d2").select(on, "metric", "res1", "d2", *keep)


def outcomes_of(pairs: DataFrame, outcomes: DataFrame, latin: bool = False) -> DataFrame:
    """row, kind (FN or FP), s1 and s2 of the numbered pairs whose outcome (row, res1, res2) is wrong."""
    df = (latin_only(pairs) if latin else pairs).select("row", "s1", "s2").join(outcomes, "row")
    return df.filter(F.col("res1") != F.col("res2")).select("row", F.when(F.col("res1"), "FN").otherwise("FP").alias("kind"), "s1", "s2")


def runs_of(pairs: DataFrame, first: DataFrame, second: DataFrame, metrics: list[str], latin: bool = False) -> DataFrame:
    """row, metric, s1, s2, res and the second run's strings where the first of two runs over the numbered pairs decides
    rightly and the second wrongly. Runs have row, real, the metrics as TRUE or FALSE, a and b, and may list rows in any order."""
    said = lambda df, *more: df.select("row", (F.col("real") == "TRUE").alias("res"), *((F.col(m) == "TRUE").alias(m) for m in metrics), *more)
    forms = {"transformed_s1": "a", "transformed_s2": "b"}
    rows = regressions(said(first), said(second, *(F.col(c).alias(n) for n, c in forms.items())), metrics, "row", tuple(forms))
    named = (latin_only(pairs) if latin else pairs).select("row", "s1", "s2", "res")
    return rows.select("row", "metric", *forms).join(named, "row").select("row", "metric", "s1", "s2", "res", *forms)


def true_first(df: DataFrame, *ties: str) -> DataFrame:
    return df.orderBy(F.desc("res"), *ties)


def inconsistent(first: DataFrame, second: DataFrame, on: str = "pair_id") -> DataFrame:
    """Pairs whose ground truth differs between two runs."""
    return first.select(on, F.col("res").alias("res1")).join(second.select(on, F.col("res").alias("res2")), on).filter("res1 <> res2")
