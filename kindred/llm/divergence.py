"""How far the sources of a language lie apart, by the words that they use: counts and pair sums by shard in DuckDB.

Tasks cut texts into terms and count them before anything is shuffled; rows then meet in shards by hash of language
and term, so that neither a language nor a source is in one task. In each shard DuckDB sums the counts, drops rare
terms and, once Spark has the totals, makes the shard's part of each pair's sum and its first terms of each group.
Spark adds the parts up and ranks.

A pair's sum runs over all kept terms of its language, most of which most sources lack. f(p, q) of a term that one
of both lacks depends on the other's count alone, so those are summed by distinct counts; a shard's SQL only has
the terms that both have, as what they add beyond that.

Defined results: null text, language and source count as ''; an empty text has no terms, its group is there all the
same; a very long text is counted whole; rows that repeat count as often as they occur (in the documents that a
term needs, too); of equal values the item that is smaller in UTF-8 ranks first; null doc_ids don't matter; an empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from tempfile import TemporaryDirectory

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_broadcast, small, table, written

#: Documents of a language that a term must be in, and the terms of a group that are reported.
LEAST, FIRST = 3, 200
#: Terms that a task counts before it passes them on.
HELD = 300_000
#: Memory of a shard's database beyond which it spills.
MEMORY = "300MB"
#: Bytes that separate terms become blanks, A-Z small; bytes of other characters stay.
TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x61 or 0x7B <= b <= 0x7F else b for b in range(256))

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

#: The SQL of a shard: counts by group and term, and the terms of enough documents.
SUM = """CREATE TABLE c AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM incoming GROUP BY ALL"""
KEEP = """SELECT lang, source, term, n, total, source = least AS first
FROM c JOIN (SELECT lang, term, sum(n)::BIGINT AS total, min(source) AS least FROM c GROUP BY ALL HAVING sum(docs) >= {least}) AS k USING (lang, term)"""
#: Then, with the words of groups and languages and the number of kept terms: frequencies, pairs, counts of counts, first terms.
SHARES = """CREATE TABLE c AS SELECT lang, source, term, n, 1 + ((1000000000::HUGEINT * (n + 1)) // (words + vocabulary))::BIGINT AS p,
       1 + 1000000000 // (words + vocabulary) AS p0, 1 + ((1000000000::HUGEINT * (total + 1)) // (all_words + vocabulary))::BIGINT AS q FROM incoming"""
PARTS = """SELECT 'pair' AS kind, lang, a.source AS source, b.source AS item, 0::BIGINT AS n,
       sum((a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.p0) * (a.p - b.p0) // b.p0
         - (a.p0 - b.p) * (a.p0 - b.p) // b.p + (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0)::DECIMAL(38, 0) AS value
FROM c AS a JOIN c AS b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
UNION ALL
SELECT 'count', lang, source, '', n, count(*)::DECIMAL(38, 0) FROM c GROUP BY ALL
UNION ALL
SELECT 'term', lang, source, term, n, value::DECIMAL(38, 0)
FROM (SELECT *, (p - q) * (p - q) // q AS value FROM c WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {first})"""


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term: occurrences, and rows of documents with the term, of a task's rows."""
    occurrences: dict[tuple[str, str], Counter] = {}
    documents: dict[tuple[str, str], Counter] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurrences.items():
            own, terms = documents[lang, source], list(counts)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                columns = ([lang] * len(part), [source] * len(part), [t.decode() for t in part], [counts[t] for t in part], [own[t] for t in part])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTS, strict=True)], schema=COUNTS)
        occurrences.clear()
        documents.clear()

    for b in small(batches, 200):
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            terms = text.encode().translate(TERMS).split()
            if terms:
                occurrences.setdefault((lang, source), Counter()).update(terms)
                documents.setdefault((lang, source), Counter()).update(set(terms))
        if sum(map(len, occurrences.values())) > HELD:
            yield from flushed()
    yield from flushed()


def in_duckdb(df: DataFrame, prepare: str, query: str, schema: str) -> DataFrame:
    """query's rows for each partition of df by itself, after prepare has read the partition (as the table incoming)."""
    arrow = df.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with TemporaryDirectory() as spill, duckdb.connect(":memory:", config={"memory_limit": MEMORY, "threads": 1, "temp_directory": spill, "preserve_insertion_order": False}) as db:
            db.register("incoming", pa.RecordBatchReader.from_batches(arrow, (b.cast(arrow) for b in batches)))
            db.execute(prepare)
            yield from db.sql(query).to_arrow_reader(20_000)

    return df.mapInArrow(run, schema)


def frequency(n: str, total: str = "words + vocabulary") -> Column:
    """1 + floor(1000000000 * (n + 1) / total), exactly; total counts as 1 at least."""
    return F.expr(f"1L + cast(1000000000 as decimal(10, 0)) * cast({n} + 1 as decimal(19, 0)) div cast(greatest({total}, 1L) as decimal(19, 0))")


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: other sources by their distance, and terms that set a source apart."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    kept = written(in_duckdb(counts, SUM, KEEP.format(least=LEAST), "lang string, source string, term string, n long, total long, first boolean"), "divergence-terms")
    # A row a group: its words, its language's words and kept terms.
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count_if("first").alias("terms"))
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).join(sums, ["lang", "source"], "left")
    every = W.partitionBy("lang")
    groups = groups.select("lang", "source", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce(F.sum("words").over(every), F.lit(0)).alias("all_words"), F.coalesce(F.sum("terms").over(every), F.lit(0)).alias("vocabulary"))
    groups = written(groups, "divergence-groups")
    few = bounded_broadcast(groups)
    shards = kept.drop("first").join(few, ["lang", "source"]).repartition("lang", "term")
    parts = written(in_duckdb(shards, SHARES, PARTS.format(first=FIRST), "kind string, lang string, source string, item string, n long, value decimal(38, 0)"), "divergence-parts")

    distance = lambda p, q: F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})").cast("decimal(38, 0)")
    zero = frequency("0")
    a = groups.select("lang", "source", "words", "vocabulary", zero.alias("p0"))
    b = bounded_broadcast(groups.select("lang", F.col("source").alias("item"), zero.alias("q0")))
    # Terms by their counts in a group, met by all other groups of the language as if these lacked them.
    sizes = parts.filter("kind = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").cast("long").alias("terms"))
    lone = sizes.join(bounded_broadcast(a), ["lang", "source"]).withColumn("p", frequency("n")).join(b, "lang").filter("source <> item")
    many = F.col("terms").cast("decimal(19, 0)")
    as_first = lone.select("lang", "source", "item", (distance("p", "q0") * many).alias("value"))
    as_second = lone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (distance("q0", "p") * many).alias("value"))
    # What remains: terms that both lack, where those that both have count as minus one, as they did twice above.
    own = sizes.groupBy("lang", "source").agg(F.sum("terms").alias("own"))
    with_own = groups.select("lang", "source", "vocabulary", zero.alias("p0")).join(own, ["lang", "source"], "left").fillna(0, ["own"])
    other = bounded_broadcast(with_own.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own").alias("others")))
    neither = with_own.join(other, "lang").filter("source <> item").select("lang", "source", "item", (distance("p0", "q0") * (F.col("vocabulary") - F.col("own") - F.col("others")).cast("decimal(19, 0)")).alias("value"))
    both = parts.filter("kind = 'pair'").select("lang", "source", "item", "value")
    sums = None
    for x in (both, as_first, as_second, neither):
        x = x.withColumn("value", F.col("value").cast("decimal(38, 0)"))
        sums = x if sums is None else sums.unionByName(x)
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))
    terms = ranked(parts.filter("kind = 'term'"), "term").filter(F.col("rank") <= FIRST)
    return ranked(pairs, "pair").unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


#: The same by one query over all terms of all groups.
OP13_SQL = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
w AS (SELECT lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {LEAST}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM grid),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM (SELECT lang, term, sum(n)::BIGINT AS n FROM p GROUP BY ALL)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p AS a JOIN p AS b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r
QUALIFY part = 'pair' OR rank <= {FIRST}"""
