"""Training pairs from a gazetteer, and filters and balance of pair files. All choices are settled by hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grams, text

#: Countries of Europe and North America, Russia left out.
EUROPE = "AD AL AT AX BA BE BG BY CH CY CZ DE DK EE ES FI FO FR GB GG GI GR HR HU IE IM IS IT JE LI LT LU LV MC MD ME MK MT NL NO PL PT RO RS SE SI SJ SK SM UA VA".split()
NORTH_AMERICA = "AG AI AW BB BL BM BQ BS BZ CA CR CU CW DM DO GD GL GP GT HN HT JM KN KY LC MF MQ MS MX NI PA PM PR SV SX TC TT US VC VG VI".split()


def names_of(gazetteer: DataFrame, least: int = 3, only_latin: bool = False) -> DataFrame:
    """geonameid, country_code and names: the distinct names of over two characters of records with at least `least`."""
    alternates = F.coalesce(F.split("alternatenames", ","), F.array().cast("array<string>"))
    every = F.array_distinct(F.filter(F.concat(F.array("name", "asciiname"), alternates), lambda n: n.isNotNull() & (F.length(F.trim(n)) > 2)))
    df = gazetteer.withColumn("names", every)
    if only_latin:
        df = df.filter(F.col("country_code").isin(EUROPE + NORTH_AMERICA)).withColumn("names", F.filter("names", lambda n: text.in_alphabet(n, "Latin")))
    return df.filter(F.size("names") >= least).select("geonameid", "country_code", "names")


def positives(records: DataFrame, seed: int = 13) -> DataFrame:
    """A pair of names of one record that differ in more than case; two pairs from records of five names or more."""
    n = records.select("geonameid", "country_code", F.size("names").alias("n"), F.explode("names").alias("name"))
    w = W.partitionBy("geonameid").orderBy(F.xxhash64("geonameid", "name", F.lit(seed)), "name")
    x = n.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("name").over(w))
    return x.filter("(k = 1 OR (k = 3 AND n >= 5)) AND next IS NOT NULL AND lower(name) <> lower(next)").select(F.col("name").alias("s1"), F.col("next").alias("s2"), F.lit("TRUE").alias("res"), F.col("geonameid").alias("c1"), F.col("geonameid").alias("c2"), F.col("country_code").alias("cc1"), F.col("country_code").alias("cc2"))


def negatives(records: DataFrame, seed: int = 13) -> DataFrame:
    """For each record a name of another one that shares a bigram: records that have a bigram are put in the order of a
    hash, and each meets the one before it. Groups of a common bigram are dealt over 64 salts."""
    names = records.select("geonameid", "country_code", F.explode("names").alias("name"))
    keyed = names.withColumn("gram", F.element_at(F.array_sort(grams.grams(grams.padded(F.lower("name")), 2)), -1)).withColumn("salt", F.pmod(F.xxhash64("geonameid", F.lit(seed)), F.lit(64)))
    w = W.partitionBy("gram", "salt").orderBy(F.xxhash64("geonameid", "name", F.lit(seed)), "geonameid", "name")
    x = keyed.withColumns({"s1": F.lag("name").over(w), "c1": F.lag("geonameid").over(w), "cc1": F.lag("country_code").over(w)})
    x = x.filter("s1 IS NOT NULL AND c1 <> geonameid AND lower(s1) <> lower(name)")
    first = W.partitionBy("geonameid").orderBy(F.xxhash64("s1", "name", F.lit(seed)), "s1", "name")
    return x.withColumn("k", F.row_number().over(first)).filter("k <= 2").select("s1", F.col("name").alias("s2"), F.lit("FALSE").alias("res"), "c1", F.col("geonameid").alias("c2"), "cc1", F.col("country_code").alias("cc2"))


def pairs_of(gazetteer: DataFrame, only_latin: bool = False, seed: int = 13) -> DataFrame:
    """Labelled pairs with ids, alphabets and countries, from a gazetteer."""
    records = names_of(gazetteer, only_latin=only_latin)
    rows = positives(records, seed).unionByName(negatives(records, seed))
    return rows.select("s1", "s2", "res", "c1", "c2", text.detect_alphabet(F.col("s1")).alias("a1"), text.detect_alphabet(F.col("s2")).alias("a2"), "cc1", "cc2")


def valid(pairs: DataFrame) -> DataFrame:
    """Pairs of a known label, two-letter countries, known alphabets, numeric ids and names of three characters or more."""
    return pairs.filter("res IN ('TRUE', 'FALSE') AND length(cc1) = 2 AND length(cc2) = 2 AND a1 <> 'UND' AND a2 <> 'UND' AND c1 RLIKE '^[0-9]+$' AND c2 RLIKE '^[0-9]+$' AND length(s1) >= 3 AND length(s2) >= 3")


#: Leading bits of the hash that pairs are put in order by: a label has 4096 buckets.
BITS = 12


def balanced(pairs: DataFrame, most: int = 2_500_000, seed: int = 13) -> DataFrame:
    """As many pairs of each label, most at most, those of smallest hash, with rn: their place within the label.

    Places are counted by buckets of the hash: no task ranks a label, and buckets behind the last place are dropped
    before the shuffle. Written in the order of rn and res, positive and negative pairs take turns (see interleaved)."""
    hashed = pairs.filter("res IN ('TRUE', 'FALSE')").withColumn("__h", F.xxhash64("s1", "s2", F.lit(seed))).withColumn("__b", F.shiftrightunsigned("__h", 64 - BITS).cast("int"))
    # At most 2 * 4096 rows.
    sizes = hashed.groupBy("res", "__b").agg(F.count("*").alias("n")).collect()
    k = min(most, *(sum(r["n"] for r in sizes if r["res"] == label) for label in ("TRUE", "FALSE")))
    before, upto = [], {"TRUE": 0, "FALSE": 0}
    for r in sorted(sizes, key=lambda r: r["__b"]):
        if upto[r["res"]] < k:
            before.append((r["res"], r["__b"], upto[r["res"]]))
        upto[r["res"]] += r["n"]
    starts = F.broadcast(pairs.sparkSession.createDataFrame(before, "res string, __b int, __before long"))
    w = W.partitionBy("res", "__b").orderBy("__h", *pairs.columns)
    ranked = hashed.join(starts, ["res", "__b"]).withColumn("rn", F.row_number().over(w) + F.col("__before"))
    return ranked.filter(F.col("rn") <= k).select(*pairs.columns, "rn")


def interleaved(balanced_pairs: DataFrame) -> DataFrame:
    """Pairs of both labels in turns, the positive one first; rn is dropped."""
    return balanced_pairs.orderBy("rn", F.desc("res")).drop("rn")
