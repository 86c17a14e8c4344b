"""Pairs, strings and a gazetteer made of the warehouse tables, and the SQL for them."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking
from ..sources import files

#: Names are a small vocabulary; beyond so many the pairs are not made.
NAMES = 20_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def part_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All unordered pairs of distinct part names; TRUE if their last words agree."""
    names = table(spark, sf, "part").select("p_name").filter("p_name IS NOT NULL").distinct()
    n = names.limit(NAMES + 1).count()
    if n > NAMES:
        raise ValueError(f"more than {NAMES} distinct names")
    a, b = names.select(F.col("p_name").alias("s1")), F.broadcast(names.select(F.col("p_name").alias("s2")))
    last = lambda c: F.element_at(F.split(c, " "), -1)
    res = F.when(last("s1") == last("s2"), "TRUE").otherwise("FALSE")
    # The pairs outgrow the names: they are dealt out anew before they are scored.
    return a.join(b, F.col("s1") < F.col("s2")).repartition("s1", "s2").select("s1", "s2", res.alias("res"))


#: Each part meets so many of the next keys: the pairs grow in step with the parts. Pairs of a task, about.
STEPS, DEALT = 5, 25_000


def stepped_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of parts whose keys lie 1 to STEPS apart: k1, k2, their names with types, and TRUE if the types agree.

    An equi-join on the key: rows spread by key, whatever the names are. Parts without a name or type are left out."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("s"), F.lower("p_type").alias("t")).filter("s IS NOT NULL")
    a = parts.select(F.col("k").alias("k1"), F.col("s").alias("s1"), F.col("t").alias("t1"), F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("d")).withColumn("k2", F.col("k1") + F.col("d"))
    b = parts.select(F.col("k").alias("k2"), F.col("s").alias("s2"), F.col("t").alias("t2"))
    # The parts are few bytes, their pairs much work: they are dealt out by number, not by size.
    a = a.repartition(max(1, ceil(parts.count() * STEPS / DEALT)), "k2")
    return a.join(b, "k2").select("k1", "k2", "s1", "s2", F.when(F.col("t1") == F.col("t2"), "TRUE").otherwise("FALSE").alias("res"))


#: The least likeness of blocked pairs.
ALIKE = 0.6


def blocked_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of distinct part names with types that are alike, found without comparing all: s1, s2, TRUE if their types agree, and score."""
    parts = table(spark, sf, "part").select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("s"))
    # The name has two words, what follows is the type.
    kind = lambda c: F.array_join(F.slice(F.split(c, " "), 3, 100), " ")
    found = blocking.pairs_alike(parts, ALIKE)
    return found.select("s1", "s2", F.when(kind("s1") == kind("s2"), "TRUE").otherwise("FALSE").alias("res"), "score")


def pair_file(spark: SparkSession, sf: str) -> str:
    """The path of a file of stepped pairs in order of their keys, as pair files are laid out."""
    path = files.shared_path(spark, "pairs")
    ordered = stepped_pairs(spark, sf).orderBy("k1", "k2")
    files.write_tsv(ordered.select("s1", "s2", "res", "k1", "k2", *(F.lit(x).alias(c) for c, x in (("a1", "LATIN"), ("a2", "LATIN"), ("cc1", "GR"), ("cc2", "GR")))), path)
    return path


def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    """A record a brand and size, whose names are its parts' names."""
    parts = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    ids = F.abs(F.xxhash64("p_brand", "p_size")).cast("string")
    return parts.select(ids.alias("geonameid"), F.element_at("names", 1).alias("name"), F.element_at("names", 1).alias("asciiname"), F.array_join("names", ",").alias("alternatenames"), F.lit("GR").alias("country_code"))


PAIRS_SQL = """n AS (SELECT DISTINCT p_name AS n FROM part WHERE p_name IS NOT NULL),
p AS (SELECT a.n AS s1, b.n AS s2, string_split(a.n, ' ')[-1] = string_split(b.n, ' ')[-1] AS y FROM n AS a JOIN n AS b ON a.n < b.n)"""
STEPPED_SQL = f"""n AS (SELECT p_partkey AS k, p_name || ' ' || lower(p_type) AS s, lower(p_type) AS t FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL),
p AS (SELECT a.k AS k1, b.k AS k2, a.s AS s1, b.s AS s2, a.t = b.t AS y FROM (SELECT *, unnest(range(1, {STEPS + 1})) AS d FROM n) AS a JOIN n AS b ON b.k = a.k + a.d)"""
#: All pairs that share a gram, counted by the grams that they share.
BLOCKED_SQL = f"""n AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS s FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL),
gr AS (SELECT s, unnest(list_distinct(list_concat(list_transform(range(1, length(s) + 2), lambda i: substring(' ' || s || ' ', i, 2)), list_transform(range(1, length(s) + 1), lambda i: substring(' ' || s || ' ', i, 3))))) AS gram FROM n),
z AS (SELECT s, count(*) AS size FROM gr GROUP BY s),
o AS (SELECT a.s AS s1, b.s AS s2, count(*) AS shared FROM gr AS a JOIN gr AS b ON a.gram = b.gram AND a.s < b.s GROUP BY ALL),
p AS (SELECT s1, s2, string_split(s1, ' ')[3:] = string_split(s2, ' ')[3:] AS y, shared / (x.size + y.size - shared) AS score
      FROM o JOIN z AS x ON x.s = s1 JOIN z AS y ON y.s = s2 WHERE shared / (x.size + y.size - shared) >= {ALIKE})"""
