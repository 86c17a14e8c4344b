"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are as wide as the vectors, in words of 64 bits. They are cut into segments of a word's bits, and an index holds each distinct code under each of its segments' values. In
round r a query looks up all values that differ from its own segments in r bits. What it has not met then
differs in more than r bits in every segment, so that all codes within m (r + 1) - 1 bits have been met;
a query ends when its kth verified distance is no larger. When a round would look up more values than there
are codes, the queries left over meet all codes in blocks instead.

Defined results: rows without an id, or without a whole vector (null components and NaN count as missing) of
the most common width (the smallest of those most common), take no part; rows that repeat an id and a code count once; equal distances rank by id; an empty
table, and a single row, give an empty result. Vectors of any width are taken. Further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_broadcast, table, written

#: Bits of a word.
WORD = 64


def codes(df: DataFrame) -> DataFrame:
    """vec_id, code (array of long: bit i % 64 of word i / 64 is set if component i is positive) and width (bits)."""
    v = F.col("embedding")
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    rows = df.filter(F.col("vec_id").isNotNull() & whole)
    widths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    width = widths[0]["n"] if widths else 0
    word = f"aggregate(transform(slice(embedding, {WORD} * w + 1, {WORD}), (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"
    bits = F.expr(f"transform(sequence(0, {max(0, -(-width // WORD) - 1)}), w -> {word})")
    return rows.filter(F.size("embedding") == width).select("vec_id", bits.alias("code"), F.lit(width).alias("width")).dropDuplicates(["vec_id", "code"])


def segments(n: int, bits: int) -> list[tuple[int, int, int]]:
    """Word, shift and width of each segment: about as many values as there are codes."""
    out = []
    for word in range(-(-bits // WORD)):
        own = min(WORD, bits - WORD * word)
        m = min(own, 16, max(1 if bits > WORD else 2, math.ceil(own / math.log2(max(n, 4)))))
        ends = [own * (i + 1) // m for i in range(m)]
        out += [(word, a, b - a) for a, b in zip([0, *ends], ends, strict=False)]
    return out


def _cut(parts: list[tuple[int, int, int]]):
    """seg and val of every segment of code."""
    return F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned(F.col("code")[word], a).bitwiseAND(F.lit((1 << w) - 1 if w < WORD else -1)).alias("val")) for i, (word, a, w) in enumerate(parts))))


def _distance(a: str, b: str, words: int):
    return reduce(add, (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(words))).cast("int")


def _flips(spark: SparkSession, parts: list[tuple[int, int, int]], r: int) -> DataFrame:
    rows = [(i, sum(1 << b for b in bits)) for i, (_, _, w) in enumerate(parts) for bits in itertools.combinations(range(w), r)]
    return spark.createDataFrame(rows, "s int, flip long")


def search(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = 2000) -> DataFrame:
    """query_id, rank, vec_id and distance of the k nearest rows for each query (both as codes() gives them); own ids are left out."""
    spark = rows.sparkSession
    wide = rows.select("width").limit(1).collect()
    if not wide:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance int")
    width = wide[0]["width"]
    words = -(-width // WORD)
    rows, queries = rows.select("vec_id", "code"), queries.select("vec_id", "code")
    # Of the rows of one code only the k + 1 smallest ids can be among the k nearest.
    rank = F.row_number().over(W.partitionBy("code").orderBy("vec_id"))
    members = written(rows.withColumn("r", rank).filter(F.col("r") <= k + 1).drop("r"), "hamming-members")
    distinct = written(members.groupBy("code").agg(F.count("*").alias("n")), "hamming-codes")
    total = distinct.count()
    parts = segments(total, width)
    index = written(distinct.select(_cut(parts).alias("x"), "code", "n").select("x.seg", "x.val", "code", "n"), "hamming-index")
    left = written(queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")).distinct().withColumn("kth", F.lit(width)), "hamming-queries")
    met = None
    for r in range(max(w for _, _, w in parts) + 1):
        if not left.limit(1).count():
            break
        # Codes further off than the kth that a query has met by now don't matter; ties with it do.
        useful = _distance("q", "code", words) <= F.col("kth")
        looked_up = sum(math.comb(w, i) for _, _, w in parts for i in range(r + 1))
        if looked_up > max(total, 1000):
            blocks = max(1, -(-left.count() // block))
            mine = left.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
            every = distinct.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            got, covered = every.join(mine, (every.b == mine.b) & useful), width
        else:
            segs = left.withColumn("code", F.col("q")).select("query_id", "q", "kth", _cut(parts).alias("x"))
            probes = segs.join(bounded_broadcast(_flips(spark, parts, r)), F.col("x.seg") == F.col("s")).select("query_id", "q", "kth", F.col("x.seg").alias("p_seg"), F.col("x.val").bitwiseXOR(F.col("flip")).alias("p_val"))
            got, covered = index.join(probes, (index.seg == F.col("p_seg")) & (index.val == F.col("p_val")) & useful), len(parts) * (r + 1) - 1
        got = got.groupBy("query_id", "q", "code").agg(F.min("n").alias("n")).withColumn("distance", _distance("q", "code", words))
        got = written(got, f"hamming-met-{r}")
        met = got if met is None else met.unionByName(got)
        w = W.partitionBy("query_id").orderBy("distance")
        by_distance = met.dropDuplicates(["query_id", "code"]).groupBy("query_id", "distance").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w))
        kth = by_distance.filter(F.col("upto") > k).groupBy("query_id").agg(F.min("distance").alias("now"))
        left = written(left.join(kth, "query_id", "left").select("query_id", "q", F.coalesce("now", "kth").alias("kth")).filter(F.col("kth") > covered), f"hamming-left-{r}")
    if met is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance int")
    met = met.dropDuplicates(["query_id", "code"])
    upto = F.sum("n").over(W.partitionBy("query_id").orderBy("distance")) - F.sum("n").over(W.partitionBy("query_id", "distance"))
    near = met.withColumn("before", upto).filter(F.col("before") <= k)
    near = near.join(members, "code").filter(F.col("vec_id") != F.col("query_id"))
    return near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op9_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(codes(table(spark, sf_dir, "embeddings")), "hamming-rows")
    return search(rows, rows.filter(F.col("vec_id") % 100 == 0))


OP9_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, 65), lambda i: (q.b[i] <> v.b[i])::INT))::INT AS distance
      FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
