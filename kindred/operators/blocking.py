"""Candidate pairs: all pairs of strings whose gram sets are alike enough, without comparing all pairs.

Grams (of two and three characters of the padded string, as in the jaccard metric) are ordered by how many strings have them, the
rarest first. Two strings of a Jaccard similarity of `least` or more share a gram among the first few of both; how few,
follows from their sizes. So strings meet by those grams alone, and pairs whose sizes or places rule the similarity out
are dropped in the join. Grams that lead more than BLOCK strings are split into blocks, which meet two by two in tasks of
their own. What remains is confirmed on the strings.

Defined results: null strings take no part; equal strings are one string; a string of fewer than two characters has grams, as
it is padded; an empty table gives an empty result. Further columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grams

#: Strings that a gram leads, beyond which it is split, and grams whose frequencies are broadcast.
BLOCK, BROADCAST = 500, 1_000_000


def _gram_set(s: Column) -> Column:
    return F.array_distinct(F.concat(grams.grams(grams.padded(s), 2), grams.grams(grams.padded(s), 3)))


def leading(strings: DataFrame, least: float) -> DataFrame:
    """s, size, gram and place: the grams of each string of which one is shared with every string alike enough."""
    sets = strings.filter("s IS NOT NULL").select("s").distinct().withColumn("grams", _gram_set(F.col("s"))).withColumn("size", F.size("grams"))
    rows = sets.select("s", "size", F.explode("grams").alias("gram"))
    often = rows.groupBy("gram").agg(F.count("*").alias("n"))
    often = F.broadcast(often) if often.limit(BROADCAST + 1).count() <= BROADCAST else often
    # An array a string: as long as the string.
    ordered = rows.join(often, "gram").groupBy("s", "size").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    kept = F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9) + 1
    return ordered.select("s", "size", F.posexplode(F.slice("grams", 1, kept.cast("int"))).alias("place", "g")).select("s", "size", "place", "g.gram")


def pairs_alike(strings: DataFrame, least: float) -> DataFrame:
    """s1, s2 (the smaller string first) and score of all pairs of distinct strings whose jaccard is least or more."""
    if not 0 < least <= 1:
        raise ValueError("least lies above 0 and is 1 at most")
    lead = leading(strings, least)
    hot = lead.groupBy("gram").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK).select("gram", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    lead = lead.join(hot, "gram", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"))
    # Blocks i <= j meet as (i, j): a string of block b goes to all of b's pairs, and meets those of its own block once.
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = lead.withColumn("with", partner).withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
    side = lambda k: dealt.select("gram", "low", "high", *(F.col(c).alias(f"{c}{k}") for c in ("s", "size", "place", "block")))
    a, b = side(1), side(2)
    # Strings of one block meet in (b, b) only, those of two in (i, j) only.
    own = (F.col("low") == F.col("high")) | (F.col("block1") != F.col("block2"))
    shared = F.lit(least / (1 + least)) * (F.col("size1") + F.col("size2")) - 1e-9
    # Grams that are still to come from this one on.
    possible = F.least(F.col("size1") - F.col("place1"), F.col("size2") - F.col("place2"))
    fits = (F.col("size1") >= least * F.col("size2") - 1e-9) & (F.col("size2") >= least * F.col("size1") - 1e-9) & (possible >= shared)
    met = a.join(b, ["gram", "low", "high"]).filter((F.col("s1") < F.col("s2")) & own & fits).select("s1", "s2").distinct()
    return met.withColumn("score", grams.jaccard(F.col("s1"), F.col("s2"))).filter(F.col("score") >= least)

