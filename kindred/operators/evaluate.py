"""From pairs to decisions and quality reports."""

from __future__ import annotations

from collections.abc import Callable
from time import perf_counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params
from ..functions import metrics, terms, text
from ..schema import label

#: The term similarity that sorted runs add, simple and averaged.
BOTH_TERMS = dict(zip(params.TERM_DECISIONS, (("damerau_levenshtein", False, False), ("damerau_levenshtein", True, False)), strict=True))


#: Fixed value: pairs less alike without spaces are sorted.
SORTED_BELOW = 0.45


def transformed(df: DataFrame, sorting=False, canonical=False, simple_sorting=True, sort_thres=SORTED_BELOW, a="s1", b="s2") -> DataFrame:
    """df with a and b: the pair, made canonical and sorted by tokens as asked for.

    Without simple sorting, tokens are sorted only if the strings without spaces are less alike than
    sort_thres; else spaces go if the strings are more alike without them."""
    x, y = F.col(a), F.col(b)
    if canonical:
        x, y = text.canonical(x), text.canonical(y)
    df = df.withColumns({"a": x, "b": y})
    if not sorting:
        return df
    if simple_sorting:
        return df.withColumns({"a": text.sorted_text(F.col("a")), "b": text.sorted_text(F.col("b"))})
    df = guarded_forms(df, a="a", b="b")
    pick = lambda side: F.when(F.col("sc") < sort_thres, F.col("ordered")[side]).otherwise(F.col("other")[side])
    return df.withColumns({"a": pick("a"), "b": pick("b")}).drop("sc", "ordered", "other")


def guarded_forms(df: DataFrame, canonical=False, a="s1", b="s2") -> DataFrame:
    """df with sc, the likeness of the strings without spaces, and two forms of the pair: ordered, with sorted tokens, and
    other, without spaces if the strings are more alike so, else as it is."""
    x, y = F.col(a), F.col(b)
    if canonical:
        x, y = text.canonical(x), text.canonical(y)
    glued = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    pair = lambda s, t: F.struct(s.alias("a"), t.alias("b"))
    df = df.withColumns({"__x": x, "__y": y}).withColumns({"__tx": glued(F.col("__x")), "__ty": glued(F.col("__y"))})
    df = df.withColumns({"sc": metrics.score(F.col("__tx"), F.col("__ty"), "damerau_levenshtein"), "__so": metrics.score(F.col("__x"), F.col("__y"), "damerau_levenshtein")})
    other = F.when(F.col("sc") > F.col("__so"), pair(F.col("__tx"), F.col("__ty"))).otherwise(pair(F.col("__x"), F.col("__y")))
    return df.withColumns({"ordered": pair(text.sorted_text(F.col("__x")), text.sorted_text(F.col("__y"))), "other": other}).drop("__x", "__y", "__tx", "__ty", "__so")


def scored(df: DataFrame, names) -> DataFrame:
    """df (with a, b) and a column a metric: one Python stage for all."""
    names = list(names)
    df = df.withColumn("__s", metrics.scores(F.col("a"), F.col("b"), names))
    return df.withColumns({n: F.col("__s")[n] for n in names}).drop("__s")


def long(df: DataFrame, names, *keep: str) -> DataFrame:
    """A row a pair and metric: method and score."""
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(n).alias("method"), F.col(n).alias("score")) for n in names))).alias("x")).select(*keep, "x.method", "x.score")


def threshold_table(spark: SparkSession, mode: str) -> DataFrame:
    return spark.createDataFrame([(i, m, t) for i, m, own, t in params.thresholds() if own == mode], "method_id int, method string, thres double")


def ratios(counts: DataFrame, missing: float | None = None) -> DataFrame:
    """accuracy, precision, recall and f1 beside tp, fn, fp and tn. missing replaces what can't be divided."""
    fill = (lambda c: F.coalesce(c, F.lit(missing))) if missing is not None else (lambda c: c)
    precision, recall = fill(F.try_divide("tp", F.col("tp") + F.col("fp"))), fill(F.try_divide("tp", F.col("tp") + F.col("fn")))
    return counts.withColumns({"accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")), "precision": precision, "recall": recall}).withColumn("f1", fill(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def counted(decided: DataFrame, *keys: str, real: str = "label", predicted: str = "predicted", rows: str | None = None) -> DataFrame:
    """tp, fn, fp and tn by keys: one hash aggregate, with partial sums before the shuffle. A row counts once, or as often as rows says."""
    yes, hit = F.col(real) > 0, F.col(predicted)
    total = (lambda when: F.coalesce(F.sum(F.when(when, F.col(rows))), F.lit(0).cast("long"))) if rows else F.count_if
    return decided.groupBy(*keys).agg(total(yes & hit).alias("tp"), total(yes & ~hit).alias("fn"), total(~yes & hit).alias("fp"), total(~yes & ~hit).alias("tn"))


def repeated(pairs: DataFrame) -> DataFrame:
    """label, s1, s2 and rows: each labelled pair once, and how often it is there, so that it is scored once."""
    return pairs.groupBy(label(F.col("res")).alias("label"), "s1", "s2").agg(F.count("*").alias("rows"))


def confusion(scores: DataFrame, mode: str) -> DataFrame:
    """Quality by method of a long table (label, rows, method, score); methods without a true positive are left out."""
    table = F.broadcast(threshold_table(scores.sparkSession, mode))
    return ratios(counted(scores.join(table, "method").withColumn("predicted", F.col("score") >= F.col("thres")), "method", rows="rows")).filter(F.col("f1").isNotNull())


def class_counts(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_if(label(F.col("res")) > 0).alias("num_true"), F.count_if(label(F.col("res")) == 0).alias("num_false"))


def evaluate_metrics(pairs: DataFrame, sorting=False, canonical=False, permuted=False, latin=False, encoding=None, names=None, thres: float | None = None, frequent=()) -> DataFrame:
    """The basic evaluator: all metrics on transformed pairs, decided by the mode's thresholds or one given."""
    names = list(names or params.EVALUATED) + (["permuted_winkler"] if permuted else [])
    df = scored(transformed(repeated(pairs), sorting, canonical), names)
    if sorting:
        df = df.withColumn("__l", terms.lsim_scores(F.col("a"), F.col("b"), BOTH_TERMS, frequent=frequent)).select("*", "__l.*").drop("__l")
        names += BOTH_TERMS
    rows = long(df, names, "label", "rows")
    if thres is None:
        return confusion(rows, params.threshold_mode(sorting, latin, encoding))
    return ratios(counted(rows.withColumn("predicted", F.col("score") >= thres), "method", rows="rows")).filter(F.col("f1").isNotNull())


def said(pairs: DataFrame, decide: Callable[[DataFrame], DataFrame], table: dict[str, float]) -> DataFrame:
    """A result file's columns: decide gives pairs their scores and transformed strings a and b, table has the scores' thresholds.

    Rows of numbered pairs may come in any order: equal pairs are transformed and scored once, and meet their rows again.
    Pairs without numbers keep their order, as their lines are what tells them apart."""
    say = lambda c: F.upper(c.cast("string"))
    real, every = say(label(F.col("res")) > 0).alias("real"), [say(F.col(n) >= t).alias(n) for n, t in table.items()]
    if "row" not in pairs.columns:
        return decide(pairs).select(real, *every, "a", "b")
    once = decide(pairs.select("s1", "s2").distinct()).select(F.col("s1").alias("__s1"), F.col("s2").alias("__s2"), *every, "a", "b")
    rows = pairs.select("row", "s1", "s2", real)
    return rows.join(once, F.col("s1").eqNullSafe(F.col("__s1")) & F.col("s2").eqNullSafe(F.col("__s2"))).drop("__s1", "__s2")


def decisions(pairs: DataFrame, sorting=False, canonical=False, names=params.EVALUATED, latin=False, encoding=None, frequent=()) -> DataFrame:
    """real, a decision a metric in order of evaluation (sorted runs: and the two term metrics), and the transformed strings:
    what a result file holds. Of numbered pairs row, s1 and s2 come first, by which runs are compared."""
    table = {m: t for _, m, mode, t in params.thresholds() if mode == params.threshold_mode(sorting, latin, encoding)}

    def decide(df: DataFrame) -> DataFrame:
        df = scored(transformed(df, sorting, canonical), names)
        if sorting:
            df = df.withColumn("__l", terms.lsim_scores(F.col("a"), F.col("b"), BOTH_TERMS, frequent=frequent)).select("*", "__l.*").drop("__l")
        return df

    return said(pairs, decide, {n: table[n] for n in (*names, *(BOTH_TERMS if sorting else ()))})


def evaluate_lsimilarities(pairs: DataFrame, sorting=True, canonical=False, latin=False, encoding=None, profile="global", frequent=()) -> DataFrame:
    """Averaged term metrics; reversed ones reverse whole strings and take the plain metric's parameters."""
    specs = {f"avg_lsim_{m}": (m.removesuffix("_r"), True, m.endswith("_r")) for m in params.TERM_METRICS}
    df = transformed(repeated(pairs), sorting, canonical, simple_sorting=False)
    df = df.select("label", "rows", terms.lsim_scores(F.col("a"), F.col("b"), specs, profile, frequent).alias("l")).select("label", "rows", "l.*")
    return confusion(long(df, list(specs), "label", "rows"), params.threshold_mode(sorting, latin, encoding))


def evaluate_at(pairs: DataFrame, thres: float, split_thres: float = 0.55, weights=params.GLOBAL_WEIGHTS, frequent=()) -> DataFrame:
    """Averaged term metrics with one split threshold, one set of weights and one decision threshold."""
    df = pairs.select(label(F.col("res")).alias("label"), F.explode(terms.components_by_split(F.col("s1"), F.col("s2"), params.TERM_METRICS, [split_thres], frequent)).alias("x")).select("label", "x.*")
    score = terms.weighted(F.col("scores"), F.col("n"), F.col("chars"), F.col("same"), F.array(*map(F.lit, weights)))
    return ratios(counted(df.withColumn("predicted", score >= thres), "metric")).filter(F.col("f1").isNotNull())


def seconds_by_metric(pairs: DataFrame, names=params.EVALUATED, sorting=False, canonical=False) -> DataFrame:
    """method, pairs and seconds: each metric's scores are computed in a job of their own, on pairs transformed and kept before."""
    ready = transformed(pairs, sorting, canonical).select("a", "b").cache()
    n, took = ready.count(), []
    for name in names:
        began = perf_counter()
        scored(ready, [name]).select(name).write.format("noop").mode("overwrite").save()
        took.append((name, n, perf_counter() - began))
    ready.unpersist()
    return pairs.sparkSession.createDataFrame(took, "method string, pairs long, seconds double")


def term_decisions(pairs: DataFrame, sorting=True, canonical=False, latin=False, encoding=None, profile="global", frequent=()) -> DataFrame:
    """real, a decision a term metric in order of evaluation, and the transformed strings; row, s1 and s2 first of numbered pairs."""
    table = {m: t for _, m, mode, t in params.thresholds() if mode == params.threshold_mode(sorting, latin, encoding)}
    specs = {f"avg_lsim_{m}": (m.removesuffix("_r"), True, m.endswith("_r")) for m in params.TERM_METRICS}

    def decide(df: DataFrame) -> DataFrame:
        df = transformed(df, sorting, canonical, simple_sorting=False)
        return df.withColumn("__l", terms.lsim_scores(F.col("a"), F.col("b"), specs, profile, frequent)).select("*", "__l.*").drop("__l")

    return said(pairs, decide, {n: table[n] for n in specs})


def unavailable(name: str):
    raise NotImplementedError(f"{name} has no evaluator: choose another")


def best(df: DataFrame, by: list[str], order: Column | str, *ties: Column | str) -> DataFrame:
    """The first row of each group by order (accuracy, say), then by ties."""
    from pyspark.sql import Window as W

    return df.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(order, *ties))).filter("__k = 1").drop("__k")
