"""Document fingerprints: the SIZE smallest hashes of a text's shingles, by native expressions only.

A sketch is a sorted array of hashes. Sketches of parts merge into that of the whole (merged, united), and two of them
give estimates of resemblance, containment and of the number of distinct shingles. A sketch of fewer than SIZE hashes
holds all of them: estimates from such ones are exact.

Shingles are five consecutive words, lower-cased; a shorter text that has words is one shingle.

The query compares each text with its edited form, which needs the next document in descending order of ids. Ids alone
are sorted first, which gives ranges of ids; texts then go to their range once, with the first text of each range also
put behind the range before it, so that every text meets its successor there.

Defined results: null texts count as empty; texts without words have an empty sketch, which is like another empty one
(1.0) and unlike all others (0.0); very long texts are sketched whole; null doc_ids come last, in order of
their texts' hashes, as rows that share an id do; rows that repeat follow each other; a single row follows itself; an
empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Words of a shingle, and hashes of a sketch: estimates of resemblance deviate by 0.044 at most (one standard deviation).
WORDS, SIZE = 5, 128
#: Ranges of ids for each partition of a shuffle.
RANGES = 4


def _none() -> Column:
    return F.array().cast("array<bigint>")


def words(text: Column) -> Column:
    """Lower-cased runs of anything but ASCII white space."""
    spaced = F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def smallest(hashes: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def shingle_hashes(ws: Column, n: int = WORDS) -> Column:
    """A hash a shingle of an array of words, repeated ones too."""
    many = F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.xxhash64(F.slice(ws, i, n)))
    return F.when(F.size(ws) >= n, many).when(F.size(ws) > 0, F.array(F.xxhash64(ws))).otherwise(_none())


def sketch(text: Column, size: int = SIZE) -> Column:
    """The sketch of a text."""
    bound = F.transform(F.array(words(F.coalesce(text, F.lit("")))), lambda ws: smallest(shingle_hashes(ws), size))
    return bound[0]


def fingerprint(sketched: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def united(*sketches: Column, size: int = SIZE) -> Column:
    """The sketch of the union of what was sketched."""
    return smallest(reduce(F.concat, sketches), size)


def _shares(a: Column, b: Column, size: int) -> Column:
    """both: of the hashes of the united sketch, how many are in both; of: how many those are."""
    return F.transform(F.array(united(a, b, size=size)), lambda u: F.struct(F.size(F.array_intersect(F.array_intersect(u, a), b)).alias("both"), F.size(u).alias("of")))[0]


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity of what two sketches stand for: 1.0 if both are empty."""
    share = _shares(a, b, size)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.coalesce(F.try_divide(share["both"], share["of"]), F.lit(0.0)))


def distinct(sketched: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles: exact below size."""
    last = F.element_at(sketched, -1).cast("double")
    # The share of all hashes that lie at or below the last one of the sketch.
    share = (last + F.lit(2.0**63) + 1.0) / F.lit(2.0**64)
    return F.when(F.size(sketched) < size, F.size(sketched).cast("double")).otherwise((size - 1) / share)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the first one's shingles that the second has too: 1.0 if the first is empty."""
    shared = resemblance(a, b, size) * distinct(united(a, b, size=size), size)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct(a, size)))


def merged(df: DataFrame, column: str, *keys: str, size: int = SIZE) -> DataFrame:
    """keys and a sketch of all that the rows of a key hold, whose sketches are in column.

    Hashes are made distinct first, then each task passes on the smallest of each key alone, however many rows a key has."""
    rows = df.select(*keys, F.explode(column).alias("__h")).distinct()
    first = rows.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy("__h"))).filter(F.col("__k") <= size)
    sketches = first.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(column))
    # Keys of empty sketches alone.
    every = df.select(*keys).distinct()
    same = reduce(lambda x, y: x & y, (F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys))
    return every.alias("e").join(sketches.alias("s"), same, "left").select(*(F.col(f"e.{k}").alias(k) for k in keys), F.coalesce(F.col(f"s.{column}"), _none()).alias(column))


def _digits(number: Column) -> Column:
    """A long as 16 digits in its order."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def _place(doc_id: Column, text: Column) -> Column:
    """Digits whose order is that of descending ids, nulls last, then of the texts' hashes."""
    return F.concat(F.when(doc_id.isNull(), "1").otherwise("0"), _digits(F.bitwise_not(F.coalesce(doc_id, F.lit(0)).cast("long"))), _digits(F.xxhash64(text)))


def _range_of(place: Column, starts: list[str]) -> Column:
    """The number of the range whose first place is the last of starts at or before place: looked for among every
    so-manieth start, then among those that follow."""
    step = max(1, round(len(starts) ** 0.5))
    parts = F.lit([starts[i : i + step] for i in range(0, len(starts), step)]) if len(starts) > step else F.array(F.lit(starts))
    before = lambda xs: F.size(F.filter(xs, lambda s: s <= place))
    coarse = before(F.lit(starts[::step]))
    return (F.greatest(coarse - 1, F.lit(0)) * step + before(F.get(parts, F.greatest(coarse - 1, F.lit(0)))) - 1).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch, and text and sketch of the next row in descending order of doc_id; the first follows the last."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("place", _place(F.col("doc_id"), F.col("text")))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A row a range, so what is collected is bounded by the number of partitions.
    found = rows.select("place").repartitionByRange(ranges, "place").groupBy(F.spark_partition_id()).agg(F.min("place").alias("start"))
    starts = sorted(r["start"] for r in found.collect())
    if not starts:
        return rows.select("doc_id", "text", sketch(F.col("text")).alias("sketch"), F.col("text").alias("next_text"), sketch(F.col("text")).alias("next_sketch"))
    here = _range_of(F.col("place"), starts)
    rows = rows.withColumn("range", here)
    own = F.struct(F.col("range"), F.lit(False).alias("borrowed"))
    behind = F.struct(F.when(F.col("range") == 0, len(starts) - 1).otherwise(F.col("range") - 1).cast("int").alias("range"), F.lit(True).alias("borrowed"))
    rows = rows.select("doc_id", "text", "place", F.explode(F.when(F.col("place").isin(starts), F.array(own, behind)).otherwise(F.array(own))).alias("at")).select("doc_id", "text", "place", "at.*")
    order = W.partitionBy("range").orderBy("borrowed", "place")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("sketch", sketch(F.col("text")))
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(order))
    return rows.filter(~F.col("borrowed")).select("doc_id", "text", "sketch", "next_text", "next_sketch")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited form, and how alike it is to that and to the next text."""
    rows = with_next(docs).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next_sketch"
    )
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"),
        resemblance(a, b).alias("near_edited"), resemblance(a, c).alias("near_next"),
        distinct(a).alias("n_shingles"), containment(a, b).alias("contained_in_edited"),
    )


def op12_fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
