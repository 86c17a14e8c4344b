"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and leading hash digits; the bucket in which a source's budget ends is refined
by the next digits, and again by whole keys. A document is then taken if its key is at most its source's
threshold: a filter, without sorting the documents.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of
size 0 take nothing; a very long document at its source's threshold is taken if half of it or more fits; rows that
repeat in doc_id and text have one key (a tie) and are taken together; an empty table gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, bounded_broadcast, table, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
LIMIT = 2.0
#: Hexadecimal digits of the key in each of the first two histograms: 4096 buckets.
DIGITS = 3


def _key():
    """32 hexadecimal digits that doc_id and text settle."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and key of every document."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), _key().alias("key"))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT) -> DataFrame:
    """source, source_size, target, whole (copies that all its documents get) and rest (words beyond those).

    Filling all sources in proportion to their weights until each is full stops at one level: the sources
    in the order in which they fill up give it in one pass. The windows hold one row a source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", limit * F.col("source_size"))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("budget", share * F.sum("source_size").over(everything))
    )
    fills = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before = fills.rowsBetween(W.unboundedPreceding, -1)
    s = (
        s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(fills.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
        .withColumn("target", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")))
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return s.select("source", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest"))


def _ends(rows: DataFrame, bucket) -> DataFrame:
    """The first bucket of each source whose running sum exceeds rest, and what of rest is left before it."""
    w = W.partitionBy("source").orderBy("bucket")
    return (
        rows.groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        .withColumn("upto", F.sum("n").over(w))
        .filter("upto > rest")
        .groupBy("source").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))).alias("end"))
        .select(F.col("source").alias("of"), F.col("end.bucket").alias("bucket"), F.col("end.left").alias("left"))
    )


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """of (the source) and threshold: documents with a key up to it get one copy more."""
    rows = sizes.join(bounded_broadcast(goals), sizes.source.eqNullSafe(goals.source)).select(sizes.source, "size", "key", "rest")
    first = bounded_broadcast(written(_ends(rows, F.substring("key", 1, DIGITS)), "mix-first"))
    inner = rows.join(first, rows.source.eqNullSafe(first.of) & (F.substring("key", 1, DIGITS) == first.bucket)).select("source", "size", "key", F.col("left").alias("rest"))
    second = bounded_broadcast(written(_ends(inner, F.substring("key", 1, 2 * DIGITS)), "mix-second"))
    w = W.partitionBy("source").orderBy("key")
    last = inner.join(second, inner.source.eqNullSafe(second.of) & (F.substring("key", 1, 2 * DIGITS) == second.bucket)).groupBy("source", "left", "key").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(w)).filter("2 * upto - n < 2 * left").groupBy("source").agg(F.max("key").alias("key"))
    return second.join(last, second.of.eqNullSafe(last.source), "left").select("of", F.coalesce("key", "bucket").alias("threshold"))


def _planned(sizes: DataFrame, weights, share, limit) -> DataFrame:
    """of (the source), source_size, target, whole and threshold: a row a source."""
    goals = written(targets(sizes, weights, share, limit), "mix-goals")
    cut = written(thresholds(sizes, goals), "mix-cuts")
    return bounded_broadcast(goals.join(cut, goals.source.eqNullSafe(cut.of), "left").select(goals.source.alias("of"), "source_size", "target", "whole", "rest", "threshold"))


def _copies(key, of: str = ""):
    """Where nothing is left beyond the whole copies, no key is taken, be its document empty or not: copies are 2 at most."""
    more = (F.col(f"{of}rest") > 0) & (key <= F.col(f"{of}threshold"))
    return (F.col(f"{of}whole") + F.when(more, 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, key, and copies: how often the mix takes the document.

    The taken words of a source differ from its target by half a document at its threshold at most."""
    sizes = written(sized(docs), "mix-sizes")
    plan = _planned(sizes, weights, share, limit)
    copies = _copies(F.col("key"))
    return sizes.join(plan, sizes.source.eqNullSafe(plan.of)).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", "key", copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT) -> DataFrame:
    """The rows of docs as the mix takes them, with their own columns: each as often as mix() has copies of it."""
    plan = _planned(written(sized(docs), "mix-sizes"), weights, share, limit).select(F.struct("of", "whole", "rest", "threshold").alias("__plan"))
    joined = docs.join(plan, docs.source.eqNullSafe(F.col("__plan.of")))
    copies = _copies(_key(), "__plan.")
    return joined.select(*(docs[c] for c in docs.columns), F.explode(F.array_repeat(F.lit(1), copies)).alias("__copy")).drop("__copy")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same result: every document's key is compared with running sums over its whole source.
OP1_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
f AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
m AS (SELECT *, max(CASE WHEN level <= full_at THEN level END) OVER () AS lv FROM l),
t AS (SELECT source, source_size, coalesce(least(most, lv * weight), most)::DOUBLE AS target FROM m),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT source, k, sum(size) AS n FROM d GROUP BY source, k),
c AS (SELECT source, k, n, sum(n) OVER (PARTITION BY source ORDER BY k) AS upto FROM g)
SELECT d.doc_id, d.size, w.source_size, w.target,
       (d.size * (w.whole + CASE WHEN 2 * c.upto - c.n < 2 * (w.target - w.whole * w.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.k = d.k
"""
