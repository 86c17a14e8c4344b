"""The queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import metrics, register, terms, text
from ..operators import compare, dataset, evaluate, features, ml, profile, sweep
from ..schema import label, pair_id
from ..sources import files
from . import sql
from .fixtures import BLOCKED_SQL, PAIRS_SQL, STEPPED_SQL, blocked_pairs, gazetteer, pair_file, part_pairs, stepped_pairs, table

ALL = list(params.BASIC)
#: Metrics whose scores SQL gives too.
SQL_METRICS = [m for m in ALL if m in sql.METRICS]
QUALITY = ("accuracy", "precision", "recall", "f1")
NATIVE = ("jaccard", "strike_a_match", "cosine", "skipgram")
ORIG = {m: t for _, m, mode, t in params.thresholds() if mode == "orig"}
SORTED = {m: t for _, m, mode, t in params.thresholds() if mode == "sorted"}
TREES = 10
GROUPED = ("basic", "ind")
#: Metrics of names of any number of words that SQL gives.
STEPPED = [m for m in SQL_METRICS if m != "permuted_winkler"]
#: Split thresholds and thresholds of the sweep over weights.
SPLITS, DECIDED = sweep.steps(0.6, 0.8), sweep.steps(0.35, 0.8)
#: Term metrics that SQL gives.
SQL_TERMS = [m for m in params.TERM_METRICS if m in sql.METRICS]


def _metric(name: str):
    def run(spark, sf) -> DataFrame:
        df = evaluate.scored(part_pairs(spark, sf).withColumns({"a": F.col("s1"), "b": F.col("s2")}), [name])
        return df.select("s1", "s2", F.round(name, 6).alias("score"))

    return run


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in QUALITY})


def _ordered(df: DataFrame) -> DataFrame:
    return _rounded(df)


def _docs(expr):
    """doc_id and columns over whole texts."""
    return lambda spark, sf: table(spark, sf, "documents").select("doc_id", *(c.alias(n) for n, c in expr(F.col("text")).items()))


def _features(spark, sf, groups=GROUPED) -> tuple[DataFrame, list[str]]:
    df = features.build(part_pairs(spark, sf), groups=groups, frequent=_frequent(spark, sf) if "stat" in groups else ())
    return df, [c for c in df.columns if c not in ("pair_id", "label")]


def _frequent(spark, sf) -> list[str]:
    counts = profile.ngram_counts(table(spark, sf, "part").select(F.col("p_name").alias("s")))
    return [r["term"] for r in profile.top_terms(counts, n=params.FREQUENT).collect()]


def _classifier(name: str):
    def run(spark, sf) -> DataFrame:
        # The perceptron has all features and takes all its steps.
        groups, trees = (features.GROUPS, None) if name == "nn" else (GROUPED, TREES)
        df, names = _features(spark, sf, groups)
        cut = F.pmod(F.xxhash64("pair_id"), F.lit(5)) == 0
        df = df.cache()
        quality, _ = ml.train_and_eval(df.filter(~cut), df.filter(cut), names, [name], trees)
        return quality

    return run


def _tuned(spark, sf) -> DataFrame:
    df, names = _features(spark, sf, ("basic",))
    found = [ml.tune(df.cache(), names, n, iterations=2, k=3, trees=TREES) for n in ("dt", "nb")]
    return spark.createDataFrame([(x["classifier"], str(sorted(x["params"].items())), x["cv_score"]) for x in found], "classifier string, params string, cv_score double")


def _eliminated(spark, sf) -> DataFrame:
    df, names = _features(spark, sf, ("basic",))
    kept, history = ml.eliminate(df, names, "dt", least=6, k=2)
    return spark.createDataFrame([(n, a, n == len(kept)) for n, a in history], "n_features int, accuracy double, chosen boolean")


def _importances(spark, sf) -> DataFrame:
    df, names = _features(spark, sf)
    return ml.top_importances(spark, ml.fit(df, names, ml.classifiers(len(names), TREES)["rf"]), names)


def _decided(spark, sf, mode, sorting):
    df = evaluate.scored(evaluate.transformed(part_pairs(spark, sf), sorting), NATIVE)
    at = ORIG if mode == "orig" else SORTED
    return df.select(pair_id("s1", "s2").alias("pair_id"), "s1", "s2", (label(F.col("res")) > 0).alias("res"), *((F.col(m) >= at[m]).alias(m) for m in NATIVE))


def _false_pos_neg(spark, sf) -> DataFrame:
    df = _decided(spark, sf, "orig", False)
    return compare.false_negatives_positives(df.select("s1", "s2", F.col("res").alias("res1"), F.col("jaccard").alias("res2")))


def _regressions(spark, sf) -> DataFrame:
    first, second = _decided(spark, sf, "orig", False), _decided(spark, sf, "sorted", True)
    return compare.regressions(first, second, list(NATIVE)).join(first.select("pair_id", "s1", "s2"), "pair_id").select("s1", "s2", "metric")


def _compared_runs(spark, sf) -> DataFrame:
    """Two runs over a file of pairs, whose decision files are read again and met by row."""
    pairs, runs = files.read_pairs(spark, pair_file(spark, sf), with_rows=True), []
    for sorting in (False, True):
        path = files.shared_path(spark, "decisions")
        files.write_decisions(evaluate.decisions(pairs, sorting, names=NATIVE), path)
        runs.append(files.read_decisions(spark, path))
    return compare.runs_of(pairs, *runs, list(NATIVE)).select("row", "metric", "s1", "s2", "res")


def _by_sql(spark, sf) -> DataFrame:
    """Metrics and the term split by their names in SQL."""
    register.register(spark)
    part_pairs(spark, sf).createOrReplaceTempView("kindred_pairs")
    split = ", ".join(f"t.{c}" for c in register.COLUMNS[:4])
    return spark.sql(f"SELECT s1, s2, round(jaro(s1, s2), 6) AS jaro, round(monge_elkan(s1, s2), 6) AS monge_elkan, round(avg_lsim_jaccard(s1, s2), 6) AS avg_lsim_jaccard, {split} FROM kindred_pairs, LATERAL term_split(s1, s2, 0.55) AS t")


def _pairs(expr):
    return lambda spark, sf: part_pairs(spark, sf).select("s1", "s2", *(c.alias(n) for n, c in expr(F.col("s1"), F.col("s2")).items()))


def _lsim(averaged: bool, names=params.TERM_METRICS):
    prefix = "avg_lsim_" if averaged else "lsim_"
    specs = {f"{prefix}{m}": (m, averaged, False) for m in names}
    return lambda spark, sf: part_pairs(spark, sf).select("s1", "s2", terms.lsim_scores(F.col("s1"), F.col("s2"), specs).alias("x")).select("s1", "s2", *(F.round(F.col("x")[n], 6).alias(n) for n in specs))


def _lsim_sql(averaged: bool) -> str:
    own = {m: params.PROFILES["global"][m]["avg" if averaged else "simple"] for m in SQL_TERMS}
    return sql.lsimilarity({f"{'avg_' * averaged}lsim_{m}": (m, *own[m]) for m in SQL_TERMS}, averaged)


def _words(df: DataFrame) -> DataFrame:
    return df.select(F.explode(text.wordpunct_words(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("count")).select(F.lit("gram_token").alias("kind"), "gram", "count")


def queries() -> dict:
    metric = {f"metric_{m}": _metric(m) for m in ALL}
    classifiers = {f"ml_{n}": _classifier(n) for n in ml.GRIDS}
    names = lambda spark, sf: table(spark, sf, "part").select(F.col("p_name").alias("s"))
    docs = lambda spark, sf: table(spark, sf, "documents").select(F.col("text").alias("s"))
    return metric | {
        "confusion_by_metric": lambda spark, sf: _rounded(evaluate.evaluate_metrics(part_pairs(spark, sf), names=SQL_METRICS, permuted=False)),
        "confusion_all": lambda spark, sf: _rounded(evaluate.evaluate_metrics(part_pairs(spark, sf), sorting=True, permuted=True)),
        "class_counts": lambda spark, sf: evaluate.class_counts(part_pairs(spark, sf)),
        "decisions": lambda spark, sf: evaluate.decisions(part_pairs(spark, sf), names=SQL_METRICS).select("a", "b", "real", *SQL_METRICS),
        "lsim_confusion": lambda spark, sf: evaluate.evaluate_lsimilarities(part_pairs(spark, sf)),
        "test_metrics": lambda spark, sf: evaluate.evaluate_at(part_pairs(spark, sf), 0.55),
        "sweep_threshold": lambda spark, sf: _ordered(sweep.sweep_thresholds(part_pairs(spark, sf), names=NATIVE)),
        "best_per_metric": lambda spark, sf: _ordered(sweep.best_setting(sweep.sweep_thresholds(part_pairs(spark, sf), names=NATIVE), "method")),
        **{f"sweep_threshold_{c}": (lambda spark, sf, c=c: _ordered(sweep.sweep_thresholds(part_pairs(spark, sf), c))) for c in ("basic", "sorted")},
        **{f"best_per_metric_{c}": (lambda spark, sf, c=c: _ordered(sweep.best_setting(sweep.sweep_thresholds(part_pairs(spark, sf), c), "method"))) for c in ("basic", "sorted")},
        "sweep_sorting": lambda spark, sf: sweep.sweep_sorting(part_pairs(spark, sf), canonical=True),
        "sweep_weights": lambda spark, sf: sweep.best_setting(sweep.sweep_terms(part_pairs(spark, sf), SPLITS, DECIDED), "metric"),
        "sweep_weights_standard": lambda spark, sf: _rounded(sweep.best_setting(sweep.sweep_terms(part_pairs(spark, sf), SPLITS, DECIDED, metrics=SQL_TERMS), "metric")).withColumn("weights", F.col("weights").cast("string")),
        "term_split": lambda spark, sf: part_pairs(spark, sf).select("s1", "s2", terms.term_split(F.col("s1"), F.col("s2"), 0.55).alias("t")).select("s1", "s2", *(F.array_join(F.col("t")[g][s], ",").alias(f"{g}_{s}") for g in ("base", "mismatch", "special") for s in "ab")),
        "lsim_simple": _lsim(False),
        "lsim_avg": _lsim(True),
        "lsim_simple_standard": _lsim(False, SQL_TERMS),
        "lsim_avg_standard": _lsim(True, SQL_TERMS),
        "stepped_confusion": lambda spark, sf: _rounded(evaluate.evaluate_metrics(stepped_pairs(spark, sf), names=STEPPED)),
        "stepped_scores": lambda spark, sf: evaluate.scored(stepped_pairs(spark, sf).withColumns({"a": F.col("s1"), "b": F.col("s2")}), NATIVE).select("k1", "k2", *(F.round(m, 6).alias(m) for m in NATIVE)),
        "transform_pair": lambda spark, sf: evaluate.transformed(part_pairs(spark, sf), sorting=True, canonical=True).select("s1", "s2", "a", "b"),
        "transform_pair_guarded": lambda spark, sf: evaluate.transformed(part_pairs(spark, sf), sorting=True, simple_sorting=False).select("s1", "s2", "a", "b"),
        "normalize_strip_accents": _docs(lambda t: {"md5": F.md5(text.strip_accents(t).cast("binary"))}),
        "normalize_canonical": _docs(lambda t: {"md5": F.md5(text.canonical(t).cast("binary"))}),
        "wordpunct_tokens": _docs(lambda t: {"words": F.size(text.wordpunct_words(t)).cast("long")}),
        "token_natural_sort": _docs(lambda t: {"md5": F.md5(text.sorted_text(t).cast("binary"))}),
        "detect_alphabet": _docs(lambda t: {"alphabet": text.detect_alphabet(t), "only_latin": text.in_alphabet(t, "Latin")}),
        "token_counts": _docs(lambda t: {"tokens": text.n_tokens(t).cast("long")}),
        "dash_words": _docs(lambda t: {"dashed": text.has_dashed_words(t)}),
        "abbr_extract": _docs(lambda t: {"abbr": text.abbreviation(t)}),
        "parenthesis_flag": _docs(lambda t: {"parenthesis": text.has_parenthesis(t)}),
        "balanced_brackets": lambda spark, sf: table(spark, sf, "events").select("event_id", text.balanced_brackets(F.col("props")).alias("balanced")),
        "contains_tokens": _pairs(lambda a, b: {"contained": text.contains_tokens(a, b)}),
        "in_pos_thirds": lambda spark, sf: part_pairs(spark, sf).select("s1", "s2", F.posexplode(text.thirds(F.col("s1"))).alias("pos", "third")).select("s1", "s2", "pos", F.round(metrics.score(F.col("third"), F.col("s2"), "damerau_levenshtein"), 6).alias("score")),
        "token_ngrams": lambda spark, sf: names(spark, sf).select(F.explode(text.token_ngrams(text.tokens(F.col("s")), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("count")),
        "freq_term_flags": lambda spark, sf: names(spark, sf).distinct().select("s", text.has_frequent(F.col("s"), _frequent(spark, sf)).alias("has_freq"), F.array_join(F.transform(text.frequent_flags(F.col("s"), _frequent(spark, sf)), lambda x: x.cast("int").cast("string")), "").alias("flags")),
        "ngram_counts": lambda spark, sf: profile.ngram_counts(names(spark, sf)),
        "abbr_examples": lambda spark, sf: profile.abbreviation_counts(table(spark, sf, "conversations").select(F.col("text").alias("s"))).select("abbr", "count", F.array_join("examples", "|").alias("examples")),
        "in_pos_thirds_both": lambda spark, sf: part_pairs(spark, sf).select("s1", "s2", F.posexplode(text.thirds(F.col("s2"))).alias("pos", "third")).select("s1", "s2", "pos", F.round(metrics.score(F.col("s1"), F.col("third"), "damerau_levenshtein"), 6).alias("score")),
        "natural_order": lambda spark, sf: table(spark, sf, "part").select("p_brand", F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string"), "p_name").alias("s")).select("s", text.sorted_text(F.col("s")).alias("sorted")),
        "stop_words": lambda spark, sf: profile.stop_words(table(spark, sf, "documents")),
        "sql_functions": _by_sql,
        "abbr_counts": lambda spark, sf: profile.abbreviation_counts(docs(spark, sf)).select("abbr", "count"),
        "dash_count": lambda spark, sf: profile.dash_count(docs(spark, sf)),
        "top_freq_terms": lambda spark, sf: profile.top_terms(_words(table(spark, sf, "documents"))),
        "feature_vector": lambda spark, sf: _features(spark, sf, features.GROUPS)[0],
        "feature_stats": lambda spark, sf: profile.feature_stats(*_features(spark, sf)),
        "gazetteer_pairs": lambda spark, sf: dataset.pairs_of(gazetteer(spark, sf)),
        "dataset_filter": lambda spark, sf: dataset.valid(dataset.pairs_of(gazetteer(spark, sf))),
        "dataset_balance": lambda spark, sf: dataset.balanced(part_pairs(spark, sf)).groupBy("res").agg(F.count("*").alias("n"), F.max("rn").cast("long").alias("last")),
        "false_pos_neg": _false_pos_neg,
        "metric_regressions": _regressions,
        "compared_runs": _compared_runs,
        "blocked_pairs": lambda spark, sf: blocked_pairs(spark, sf).withColumn("score", F.round("score", 6)),
        "blocked_confusion": lambda spark, sf: _rounded(evaluate.evaluate_metrics(blocked_pairs(spark, sf), names=STEPPED)),
        "ml_cv": _tuned,
        "ml_rfe": _eliminated,
        "ml_importances": _importances,
    } | classifiers


def oracle_sql() -> dict[str, str]:
    count = lambda inner, keys: f"SELECT {keys}, count(*) AS count FROM ({inner}) GROUP BY ALL"
    low = "regexp_extract_all(lower(p_name), '[a-z]+')"
    glued = f"array_to_string({low}, '')"
    gram = lambda n: f"SELECT '{n}gram' AS kind, unnest({sql.grams(glued, n)}) AS gram FROM part"
    tokens = lambda n: f"SELECT '{'' if n == 1 else n}gram_token' AS kind, unnest(list_transform(range(1, len({low}) - {n} + 2), lambda i: array_to_string({low}[i : i + {n - 1}], ' '))) AS gram FROM part"
    decide = ", ".join(f"upper(({sql.METRICS[m]('s1', 's2')} >= {ORIG[m]})::VARCHAR) AS {m}" for m in SQL_METRICS)
    a, b = sql.sorted_text("s1"), sql.sorted_text("s2")
    punctuation = "[‘’“”''\"!?;/⧸⁄‹›«»`ʿ,.\\-]"
    ws = "list_filter(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+|[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]+'), lambda t: regexp_full_match(t, '\\p{L}+'))"
    return {f"metric_{m}": sql.metric(m) for m in SQL_METRICS} | {
        "metric_damerau_levenshtein": sql.OSA,
        "confusion_by_metric": sql.confusion({m: ORIG[m] for m in SQL_METRICS}),
        "class_counts": f"WITH {PAIRS_SQL} SELECT count(*) FILTER (y) AS num_true, count(*) FILTER (NOT y) AS num_false FROM p",
        "decisions": f"WITH {PAIRS_SQL} SELECT s1 AS a, s2 AS b, upper(y::VARCHAR) AS real, {decide} FROM p",
        "sweep_threshold": sql.sweep(NATIVE, sweep.steps(0.3, 0.85)),
        "best_per_metric": sql.sweep(NATIVE, sweep.steps(0.3, 0.85), best=True),
        "sweep_weights_standard": sql.sweep_weights(SQL_TERMS, SPLITS, DECIDED, sweep.weight_grid()),
        "term_split": sql.term_split(0.55),
        "lsim_simple_standard": _lsim_sql(False),
        "lsim_avg_standard": _lsim_sql(True),
        "stepped_confusion": sql.confusion({m: ORIG[m] for m in STEPPED}, STEPPED_SQL),
        "stepped_scores": f"WITH {STEPPED_SQL} SELECT k1, k2, {', '.join(f'round({sql.METRICS[m]("s1", "s2")}, 6) AS {m}' for m in NATIVE)} FROM p",
        "transform_pair": f"WITH {PAIRS_SQL} SELECT s1, s2, {a} AS a, {b} AS b FROM p",
        "normalize_strip_accents": "SELECT doc_id, md5(strip_accents(text)) AS md5 FROM documents",
        "normalize_canonical": f"SELECT doc_id, md5(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '{punctuation}', '', 'g')) AS md5 FROM documents",
        "wordpunct_tokens": f"SELECT doc_id, len({ws})::BIGINT AS words FROM documents",
        "detect_alphabet": "SELECT doc_id, CASE WHEN regexp_matches(text, '\\p{Cyrillic}') THEN 'CYRILLIC' WHEN regexp_matches(text, '\\p{Latin}') THEN 'LATIN' ELSE 'UND' END AS alphabet, NOT regexp_matches(replace(text, 'µ', ''), '[\\p{Cyrillic}\\p{Greek}\\p{Arabic}\\p{Han}]') AS only_latin FROM documents",
        "stop_words": f"WITH t AS (SELECT lang, list_distinct(list_transform({ws}, lambda t: lower(t))) AS ws FROM documents WHERE lang IS NOT NULL), n AS (SELECT lang, count(*) AS texts, sum(count(*)) OVER () AS all_texts FROM t GROUP BY lang), "
        "w AS (SELECT lang, word, count(*) AS no, sum(count(*)) OVER (PARTITION BY word) AS all_no FROM (SELECT lang, unnest(ws) AS word FROM t) GROUP BY lang, word) "
        "SELECT lang, word, no, row_number() OVER (PARTITION BY lang ORDER BY no DESC, word)::INT AS rank FROM w JOIN n USING (lang) WHERE 100 * no >= 30 * texts AND no * (all_texts - texts) >= 3 * (all_no - no) * texts QUALIFY rank <= 50",
        "sql_functions": f"SELECT s1, s2, jaro, monge_elkan, avg_lsim_jaccard, base_a, base_b, mismatch_a, mismatch_b FROM ({sql.term_split(0.55)}) JOIN ({_lsim_sql(True)}) USING (s1, s2) "
        f"JOIN ({sql.metric('jaro').replace('AS score', 'AS jaro')}) USING (s1, s2) JOIN ({sql.metric('monge_elkan').replace('AS score', 'AS monge_elkan')}) USING (s1, s2)",
        "token_counts": "SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')))::BIGINT AS tokens FROM documents",
        "dash_words": "SELECT doc_id, regexp_matches(text, '[\\p{L}\\p{M}\\p{N}\\p{Pc}]-[\\p{L}\\p{M}\\p{N}\\p{Pc}]') AS dashed FROM documents",
        "dash_count": "SELECT count(*) FILTER (regexp_matches(text, '[\\p{L}\\p{M}\\p{N}\\p{Pc}]-[\\p{L}\\p{M}\\p{N}\\p{Pc}]')) AS dashed FROM documents",
        "parenthesis_flag": "SELECT doc_id, regexp_matches(text, '[\\[({]') AS parenthesis FROM documents",
        "contains_tokens": f"WITH {PAIRS_SQL} SELECT s1, s2, len(list_filter(string_split(s1, ' '), lambda t: NOT contains(s2, t))) = 0 AS contained FROM p",
        "token_ngrams": count("SELECT unnest(list_transform(range(1, len(string_split(p_name, ' '))), lambda i: array_to_string(string_split(p_name, ' ')[i : i + 1], ' '))) AS gram FROM part", "gram"),
        "ngram_counts": count(" UNION ALL ".join([gram(2), gram(3), gram(4), tokens(1), tokens(2), tokens(3)]), "kind, gram"),
        "top_freq_terms": f"SELECT term, count(*) AS no FROM (SELECT unnest(list_transform({ws}, lambda t: lower(t))) AS term FROM documents) GROUP BY term ORDER BY no DESC, term LIMIT 200",
        "dataset_balance": f"WITH {PAIRS_SQL}, k AS (SELECT least(count(*) FILTER (y), count(*) FILTER (NOT y)) AS n FROM p) SELECT unnest(['TRUE', 'FALSE']) AS res, n, n AS last FROM k",
        "false_pos_neg": f"WITH {PAIRS_SQL}, d AS (SELECT *, {sql.jaccard('s1', 's2')} >= {ORIG['jaccard']} AS r FROM p) SELECT CASE WHEN y THEN 'FN' ELSE 'FP' END AS kind, s1, s2 FROM d WHERE y <> r",
        "metric_regressions": f"WITH {PAIRS_SQL}, t AS (SELECT s1, s2, y, {a} AS a, {b} AS b FROM p), d AS ("
        + " UNION ALL ".join(f"SELECT s1, s2, y, '{m}' AS metric, {sql.METRICS[m]('s1', 's2')} >= {ORIG[m]} AS d1, {sql.METRICS[m]('a', 'b')} >= {SORTED[m]} AS d2 FROM t" for m in NATIVE)
        + ") SELECT s1, s2, metric FROM d WHERE y = d1 AND y <> d2",
        "blocked_pairs": f"WITH {BLOCKED_SQL} SELECT s1, s2, upper(y::VARCHAR) AS res, round(score, 6) AS score FROM p",
        "blocked_confusion": sql.confusion({m: ORIG[m] for m in STEPPED}, BLOCKED_SQL),
        "compared_runs": f"WITH {STEPPED_SQL}, t AS (SELECT row_number() OVER (ORDER BY k1, k2) - 1 AS row, s1, s2, y, {a} AS a, {b} AS b FROM p), d AS ("
        + " UNION ALL ".join(f"SELECT row, s1, s2, y, '{m}' AS metric, {sql.METRICS[m]('s1', 's2')} >= {ORIG[m]} AS d1, {sql.METRICS[m]('a', 'b')} >= {SORTED[m]} AS d2 FROM t" for m in NATIVE)
        + ") SELECT row, metric, s1, s2, upper(y::VARCHAR) AS res FROM d WHERE y = d1 AND y <> d2",
    }
