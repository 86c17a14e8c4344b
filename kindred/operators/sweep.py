"""Sweeps over thresholds, split thresholds and weights, each as one job: scores once, then small tables of parameters."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import terms
from ..schema import label
from .evaluate import best, guarded_forms, long, ratios, scored, threshold_table, transformed


def weight_grid() -> list[tuple[float, float, float]]:
    """Weights in tenths that sum to 10: the first 3.34 or 4 to 7, the others from a short list."""
    rest = (1, 2, 3, 4, 5, 2.5, 3.33)
    return [(w / 10, x / 10, y / 10) for w in (3.34, 4, 5, 6, 7) for x in rest for y in rest if abs(w + x + y - 10) < 1e-9]


def steps(first: float, last: float, by: float = 0.05) -> list[float]:
    return [round(first + i * by, 2) for i in range(round((last - first) / by) + 1)]


def by_threshold(scores: DataFrame, thresholds: list[float], *keys: str) -> DataFrame:
    """Quality for each key and threshold of a long table (label, score); rows without a score count nowhere.

    Each row is counted once, by how many thresholds its score reaches; those histograms, of a few rows a key, are then
    summed from the top."""
    reached = reduce(add, ((F.col("score") >= t).cast("int") for t in sorted(thresholds)))
    bars = scores.filter("score IS NOT NULL").groupBy(*keys, (F.col("label") > 0).alias("yes"), reached.alias("reached")).agg(F.count("*").alias("rows"))
    return ratios(_summed(bars, "thres", sorted(thresholds), lambda i: F.col("reached") >= i, *keys), missing=0.0)


def _summed(bars: DataFrame, name: str, thresholds: list[float], predicted, *keys: str) -> DataFrame:
    """tp, fn, fp and tn by keys and threshold of a histogram (yes, rows); predicted says of the i-th threshold, from 1, which bars it takes."""
    at = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("t")) for i, t in enumerate(thresholds, 1)))
    rows = bars.withColumn("at", F.explode(at)).withColumns({name: F.col("at.t"), "hit": predicted(F.col("at.i"))})
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("rows"))), F.lit(0))
    yes, hit = F.col("yes"), F.col("hit")
    return rows.groupBy(*keys, name).agg(total(yes & hit).alias("tp"), total(yes & ~hit).alias("fn"), total(~yes & hit).alias("fp"), total(~yes & ~hit).alias("tn"))


def sweep_thresholds(pairs: DataFrame, case: str = "basic", names=None, thresholds=None) -> DataFrame:
    """The basic or sorted metrics at all thresholds."""
    names = list(names or (params.FEATURE_BASIC if case == "basic" else params.FEATURE_SORTED))
    df = scored(transformed(pairs.withColumn("label", label(F.col("res"))), sorting=case == "sorted", canonical=case == "sorted"), names)
    return by_threshold(long(df, names, "label"), thresholds or steps(0.3, 0.85), "method")


def sweep_terms(pairs: DataFrame, split_thresholds=(0.4, 0.5, 0.6, 0.7), thresholds=None, weights=None, metrics=params.TERM_METRICS, frequent=()) -> DataFrame:
    """Term metrics at all weights, split thresholds and thresholds: pairs are split once for each split threshold."""
    weights = list(weights or weight_grid())
    settings = F.array(*(F.array(*map(F.lit, w)) for w in weights))
    scores = terms.scores_by_split(F.col("s1"), F.col("s2"), metrics, split_thresholds, weights, frequent)
    df = pairs.select(label(F.col("res")).alias("label"), F.explode(scores).alias("x")).select("label", "x.metric", "x.split_thres", F.posexplode("x.scores").alias("seq", "score"))
    swept = by_threshold(df, thresholds or steps(0.3, 0.85), "metric", "seq", "split_thres")
    return swept.select("metric", "seq", F.element_at(settings, F.col("seq") + 1).alias("weights"), *(c for c in swept.columns if c not in ("metric", "seq")))


def best_setting(swept: DataFrame, by: str) -> DataFrame:
    """The most accurate setting of each metric; of equal ones the first in sweep order."""
    ties = [c for c in ("seq", "split_thres", "sort_thres", "thres") if c in swept.columns]
    return best(swept, [by], F.desc("accuracy"), *ties)


def sweep_sorting(pairs: DataFrame, names=params.EVALUATED, mode="sorted", sort_thresholds=None, canonical=False) -> DataFrame:
    """Quality of the metrics when pairs are sorted under each sorting threshold.

    Below a threshold a pair is sorted, else it has one other form, whatever the threshold: both forms are scored once,
    and counted by how many thresholds they lie below."""
    thresholds = sorted(sort_thresholds or steps(0.55, 0.85))
    df = guarded_forms(pairs.withColumn("label", label(F.col("res"))), canonical)
    # How many of the thresholds do not sort the pair: those at or below the likeness of the strings without spaces.
    kept = reduce(add, ((F.col("sc") >= t).cast("int") for t in thresholds))
    other = F.struct(F.lit(False).alias("sorted"), F.col("other.a").alias("a"), F.col("other.b").alias("b"))
    ordered = F.struct(F.lit(True).alias("sorted"), F.col("ordered.a").alias("a"), F.col("ordered.b").alias("b"))
    forms = F.when(F.col("kept") == 0, F.array(ordered)).when(F.col("kept") == len(thresholds), F.array(other)).otherwise(F.array(ordered, other))
    df = df.withColumn("kept", kept).select("label", "kept", F.explode(forms).alias("form")).select("label", "kept", "form.*")
    table = F.broadcast(threshold_table(df.sparkSession, mode))
    rows = long(scored(df, names), names, "label", "kept", "sorted").filter("score IS NOT NULL").join(table, "method")
    bars = rows.groupBy("method", (F.col("label") > 0).alias("yes"), (F.col("score") >= F.col("thres")).alias("high"), "kept", "sorted").agg(F.count("*").alias("rows"))
    # The other form counts for thresholds up to the kept-th, the sorted one from there on.
    at = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("t")) for i, t in enumerate(thresholds, 1)))
    bars = bars.withColumn("at", F.explode(at)).filter(F.col("sorted") == (F.col("at.i") > F.col("kept")))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("rows"))), F.lit(0))
    yes, hit = F.col("yes"), F.col("high")
    counts = bars.groupBy("method", F.col("at.t").alias("sort_thres")).agg(total(yes & hit).alias("tp"), total(yes & ~hit).alias("fn"), total(~yes & hit).alias("fp"), total(~yes & ~hit).alias("tn"))
    return ratios(counts).filter(F.col("f1").isNotNull())
