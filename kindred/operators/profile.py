"""Corpus profiles: counts of grams, abbreviations and dashed words, frequent terms, and feature statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grams, text


def both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("s1", "s2")).alias("s"))


def ngram_counts(strings: DataFrame, canonical: bool = True, stop_words: dict[str, list[str]] | None = None) -> DataFrame:
    """kind, gram and count over a column s: token 1- to 3-grams, and character 2- to 4-grams of the tokens joined without
    spaces. With stop_words by language those of each string's own are left out."""
    s = text.canonical(F.col("s")) if canonical else F.col("s")
    strings = strings.select(s.alias("s"))
    s = F.col("s")
    ws = strings.select((text.normalized(s, stop_words)["kept"] if stop_words else text.wordpunct_words(s)).alias("ws"))
    glued = F.array_join("ws", "")
    kinds = {"gram_token": text.token_ngrams(F.col("ws"), 1), "2gram_token": text.token_ngrams(F.col("ws"), 2), "3gram_token": text.token_ngrams(F.col("ws"), 3), **{f"{n}gram": grams.grams(glued, n) for n in (2, 3, 4)}}

    def named(kind: str, found):
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("gram")))

    rows = ws.select(F.explode(F.concat(*(named(k, g) for k, g in kinds.items()))).alias("x"))
    return rows.groupBy("x.kind", "x.gram").agg(F.count("*").alias("count"))


def stop_words(texts: DataFrame, share: int = 30, contrast: int = 3, n: int = 50) -> DataFrame:
    """lang, word, no and rank: words that at least share per cent of a language's texts have, and that are contrast times as
    frequent there as in all other languages; the n most frequent, ties in order. texts has lang and text; null languages take no part."""
    texts = texts.filter("lang IS NOT NULL")
    words = texts.select("lang", F.explode(F.array_distinct(text.wordpunct_words(F.col("text")))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("no"))
    # A row a language.
    sizes = texts.groupBy("lang").agg(F.count("*").alias("texts"))
    sizes = F.broadcast(sizes.withColumn("all_texts", F.sum("texts").over(W.partitionBy())))
    every = words.withColumn("all_no", F.sum("no").over(W.partitionBy("word"))).join(sizes, "lang")
    often = every.filter((100 * F.col("no") >= share * F.col("texts")) & (F.col("no") * (F.col("all_texts") - F.col("texts")) >= contrast * (F.col("all_no") - F.col("no")) * F.col("texts")))
    return often.select("lang", "word", "no", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("no"), "word")).alias("rank")).filter(F.col("rank") <= n)


def lists_of(words: DataFrame) -> dict[str, list[str]]:
    """Stop-words by language, in order of rank: few of them, as stop_words bounds them."""
    out: dict[str, list[str]] = {}
    for r in words.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["word"])
    return out


def abbreviation_counts(strings: DataFrame, examples: int = 10) -> DataFrame:
    """abbr, count and the first examples in code-point order: a bounded window, not a collected list."""
    found = strings.select(text.abbreviation(F.col("s")).alias("abbr"), "s").filter("abbr <> '-'")
    first = found.distinct().withColumn("k", F.row_number().over(W.partitionBy("abbr").orderBy("s"))).filter(F.col("k") <= examples).groupBy("abbr").agg(F.array_sort(F.collect_list("s")).alias("examples"))
    return found.groupBy("abbr").agg(F.count("*").alias("count")).join(first, "abbr")


def dash_count(strings: DataFrame) -> DataFrame:
    return strings.agg(F.count_if(text.has_dashed_words(F.col("s"))).alias("dashed"))


def top_terms(counts: DataFrame, kind: str = "gram_token", n: int = 200) -> DataFrame:
    """The n most frequent grams of a kind; ties by code points."""
    return counts.filter(F.col("kind") == kind).orderBy(F.desc("count"), "gram").limit(n).select(F.col("gram").alias("term"), F.col("count").alias("no"))


def feature_stats(features: DataFrame, names: list[str]) -> DataFrame:
    """feature, count, mean, std, min, quartiles, max and nulls of each column, in one pass."""
    rows = features.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names))).alias("x")).select("x.*")
    q = lambda p: F.percentile("v", p)
    return rows.groupBy("feature").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev("v").alias("std"), F.min("v").alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max("v").alias("max"), F.count_if(F.col("v").isNull()).alias("nulls"), F.mode("v", True).alias("mode"))
