"""Command line: evaluate, sweep, profile, generate and compare files of pairs."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import params
from .functions import terms
from .operators import compare, dataset, evaluate, features, ml, profile, sweep
from .sources import files

VERSION = "2.1"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kindred", description="String-pair matching on Spark")
    p.add_argument("-d", "--dataset", default="dataset-string-similarity.txt", help="comma-separated paths")
    p.add_argument("--ev", default="SotAMetrics", choices=["SotAMetrics", "SotAML", "custom", "DLearning", "TestMetrics", "customExtended", "lSimilarityMetrics", "customHyperparams"])
    p.add_argument("-e", "--encoding", choices=["all", "latin"])
    for flag in ("permuted", "stemming", "canonical", "sort", "accuracyresults", "cmp", "onlyLATIN", "optimalThres", "optimalSortingThres", "buildDataset"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--jobs", type=int, default=2)
    p.add_argument("--test", type=int)
    p.add_argument("--ml", default="all", help="comma-separated classifiers")
    p.add_argument("--fs", choices=["sfm", "rfe"])
    p.add_argument("-f", "--features", help="comma-separated True and False, one a feature")
    p.add_argument("--case", default="basic", choices=["basic", "sorted", "terms"])
    p.add_argument("--test-dataset", help="pairs that classifiers are tried on; a fifth of the dataset if missing")
    p.add_argument("--terms", help="pattern of frequent-term files")
    p.add_argument("--trees", type=int, help="trees of forests and rounds of boosting, if not the tuned numbers")
    p.add_argument("--iterations", type=int, default=300, help="settings that a random search draws for each classifier")
    p.add_argument("--halves", action="store_true", help="--cmp: the second half of the outcomes stands first, as two-fold trials write them")
    p.add_argument("--learn-stop-words", action="store_true", help="stop-words by language, learnt from a dataset of lines of language and text")
    p.add_argument("--stop-words", help="a file that --learn-stop-words wrote; --test 2 leaves out those of each string's language")
    p.add_argument("--timing", action="store_true", help="seconds by metric")
    p.add_argument("--output", default="output")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def frequent(spark: SparkSession, a) -> list[str]:
    """At most 200 terms a file."""
    return [r["term"] for r in files.frequent_terms(spark, a.terms).filter("gram_type = 'tokens'").orderBy("rank").collect()] if a.terms else []


def compared(spark: SparkSession, a, paths: list[str]) -> None:
    """A file of pairs and one of outcomes, or a file of pairs and the decisions of two runs over it: rows meet by number."""
    if len(paths) not in (2, 3):
        print("--cmp takes two or three files")
        return
    pairs = files.read_pairs(spark, paths[0], with_rows=True)
    if len(paths) == 2:
        found = compare.outcomes_of(pairs, files.read_outcomes(spark, paths[1], a.halves), a.onlyLATIN)
        for kind, name in (("FN", "false_negatives"), ("FP", "false_positives")):
            files.write_tsv(found.filter(F.col("kind") == kind).orderBy("row").select("s1", "s2"), f"{a.output}/{name}")
        found.groupBy("kind").count().show()
        return
    first, second = (files.read_decisions(spark, x) for x in paths[1:])
    metrics = [m for m in files.metrics_of(first) if m in files.metrics_of(second)]
    found = compare.runs_of(pairs, first, second, metrics, a.onlyLATIN)
    files.write_tsv(compare.true_first(found, "row").select("metric", "s1", "s2", "res", "transformed_s1", "transformed_s2"), f"{a.output}/regressions", by="metric")
    found.groupBy("metric").count().show()
    truth = lambda df: df.select("row", F.col("real").alias("res"))
    print("pairs of unequal truth:", compare.inconsistent(truth(first), truth(second), "row").count())


def learnt(spark: SparkSession, a, pairs) -> None:
    groups = ("basic", "sorted") if a.ev == "custom" else features.GROUPS if a.sort else ("basic",)
    known = frequent(spark, a)
    build = lambda df: features.build(df, groups, a.canonical, "latin" if a.onlyLATIN or a.encoding == "latin" else "global", known, keep=[c for c in ("row",) if c in df.columns])
    df = build(pairs).cache()
    names = [c for c in df.columns if c not in ("row", "pair_id", "label")]
    if a.features and not a.fs:
        df, names = features.masked(df, names, [x == "True" for x in a.features.split(",")])
    if a.test_dataset:
        train, test = df, build(files.read_pairs(spark, a.test_dataset, with_rows=a.accuracyresults))
    else:
        cut = F.pmod(F.xxhash64("pair_id"), F.lit(5)) == 0
        train, test = df.filter(~cut), df.filter(cut)
    if a.fs:
        names = ml.strongest(train, names, "rf") if a.fs == "sfm" else ml.eliminate(train, names, "rf", cross_validated=False)[0]
    algorithms = a.ml.split(",")
    wanted = ml.chosen(algorithms, len(names), a.trees)
    if a.ev == "customExtended":
        best, found = ml.perform_cv(train, names, algorithms, a.iterations, parallelism=a.jobs, trees=a.trees)
        models = {x["classifier"]: x["model"] for x in found}
        print("best:", best["classifier"], best["features"])
    elif a.ev == "customHyperparams":
        # A classifier's features are those of best cross-validated accuracy as the weakest go.
        found, models = [], {}
        for n in wanted:
            kept, history = ml.eliminate(train, names, n, trees=a.trees)
            models[n] = ml.fit(train, kept, ml.classifiers(len(kept), a.trees, train.count())[n])
            found.append({"classifier": n, "features": kept, "cv_score": max((s for _, s in history), default=None)})
    else:
        found = [ml.tune(train, names, n, iterations=a.iterations, parallelism=a.jobs, trees=a.trees) for n in wanted]
        models = {x["classifier"]: x["model"] for x in found}
    for x in found:
        print({k: v for k, v in x.items() if k != "model"})
    quality, decided = ml.train_and_eval(train, test, names, algorithms, models=models)
    quality.show(truncate=False)
    for x in found:
        ml.top_importances(spark, models[x["classifier"]], x["features"]).show(truncate=False)
    if a.accuracyresults:
        # One file a classifier and set of feature groups, which --cmp reads: the pair's row, truth and prediction.
        said = decided.select("row", (F.col("label") > 0).alias("res1"), F.col("predicted").alias("res2"), "classifier", F.lit("-".join(groups)).alias("groups"))
        files.write_tsv(said, f"{a.output}/classifiers", header=True, by=("classifier", "groups"))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kindred").getOrCreate()
    paths = a.dataset.split(",")
    if a.stemming:
        print("stemming changes nothing")
    if a.buildDataset:
        made = dataset.pairs_of(files.read_gazetteer(spark, paths), a.onlyLATIN)
        files.write_tsv(made, f"{a.output}/dataset-unfiltered")
        # Read again: the file is what later runs start from.
        made = files.read_pairs(spark, f"{a.output}/dataset-unfiltered")
        files.write_tsv(dataset.interleaved(dataset.balanced(dataset.valid(made))), f"{a.output}/dataset-string-similarity")
        return
    for p in paths:
        if not files.exists(spark, p):
            print(f"no such file: {p}")
            return
    if a.cmp:
        compared(spark, a, paths)
        return
    if a.learn_stop_words:
        found = profile.stop_words(spark.read.schema("lang string, text string").options(sep="\t", quote="").csv(paths[0]))
        files.write_tsv(found.orderBy("lang", "rank"), f"{a.output}/stop_words")
        found.groupBy("lang").count().show()
        return
    # Result files carry their rows' numbers.
    pairs = files.read_pairs(spark, paths[0], with_rows=a.accuracyresults)
    if a.timing:
        evaluate.seconds_by_metric(pairs, sorting=a.sort, canonical=a.canonical).show(50, truncate=False)
    elif a.test == 2:
        strings = profile.both(pairs)
        stopped = profile.lists_of(spark.read.schema("lang string, word string, no long, rank int").option("sep", "\t").csv(a.stop_words)) if a.stop_words else None
        files.write_tsv(profile.ngram_counts(strings, stop_words=stopped).orderBy(F.desc("count"), "gram"), f"{a.output}/grams", by="kind")
        abbreviations = profile.abbreviation_counts(strings).orderBy(F.desc("count"), "abbr")
        files.write_tsv(abbreviations.withColumn("examples", F.array_join("examples", ",")), f"{a.output}/abbr", header=True)
        abbreviations.show(50, truncate=False)
        profile.dash_count(strings).show()
    elif a.test == 3:
        sweep.best_setting(sweep.sweep_terms(pairs, sweep.steps(0.6, 0.8), sweep.steps(0.35, 0.8), frequent=frequent(spark, a)), "metric").show(50, truncate=False)
    elif a.test == 4:
        df = features.build(pairs, frequent=frequent(spark, a))
        stats = profile.feature_stats(df, params.feature_names())
        files.write_tsv(stats, f"{a.output}/feature_stats", header=True)
        stats.show(100, truncate=False)
    elif a.test == 5:
        files.write_tsv(files.term_export(pairs.withColumn("terms", terms.term_split(F.col("s1"), F.col("s2"), 0.55, frequent(spark, a)))), f"{a.output}/lsimilarity_terms")
    elif a.test is not None:
        print(f"there is no test {a.test}")
    elif a.optimalThres and a.case == "terms":
        sweep.best_setting(sweep.sweep_terms(pairs, frequent=frequent(spark, a)), "metric").show(50, truncate=False)
    elif a.optimalThres:
        sweep.best_setting(sweep.sweep_thresholds(pairs, a.case), "method").show(50, truncate=False)
    elif a.optimalSortingThres:
        if a.ev != "SotAMetrics":
            raise SystemExit("--optimalSortingThres goes with --ev SotAMetrics")
        sweep.best_setting(sweep.sweep_sorting(pairs, mode=params.threshold_mode(True, a.onlyLATIN, a.encoding), canonical=a.canonical), "method").show(50, truncate=False)
    elif a.ev == "SotAMetrics":
        evaluate.evaluate_metrics(pairs, a.sort, a.canonical, a.permuted, a.onlyLATIN, a.encoding, frequent=frequent(spark, a)).show(50, truncate=False)
        if a.accuracyresults:
            files.write_decisions(evaluate.decisions(pairs, a.sort, a.canonical, latin=a.onlyLATIN, encoding=a.encoding, frequent=frequent(spark, a)), f"{a.output}/decisions{'_canonical' * a.canonical}{'_sorted' * a.sort}")
    elif a.ev == "lSimilarityMetrics":
        evaluate.evaluate_lsimilarities(pairs, a.sort, a.canonical, a.onlyLATIN, a.encoding, frequent=frequent(spark, a)).show(50, truncate=False)
        if a.accuracyresults:
            said = evaluate.term_decisions(pairs, a.sort, a.canonical, a.onlyLATIN, a.encoding, frequent=frequent(spark, a))
            files.write_decisions(said, f"{a.output}/decisions-terms{'_canonical' * a.canonical}{'_sorted' * a.sort}")
    elif a.ev == "TestMetrics":
        evaluate.evaluate_at(pairs, 0.55, frequent=frequent(spark, a)).show(50, truncate=False)
    elif a.ev in ("SotAML", "DLearning"):
        evaluate.unavailable(a.ev)
    else:
        learnt(spark, a, pairs)


if __name__ == "__main__":
    main()
