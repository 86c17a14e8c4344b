"""Language identification by bit-sliced Bloom filters of character n-grams.

Each language's frequent n-grams are put into a Bloom filter; the filters stand side by side, so that a
place of the table holds a bit a language, and one lookup returns all languages that may hold an n-gram.
A text's bits are counted by language; the share that false positives add, known from how full a filter
is, is taken off; the largest corrected count decides, ties to the language first in code-point order.

Defined results: a null text and one without a letter get `und` and score 0; so does every text if nothing
could be learnt; a very long text is counted whole, in chunks; a null language is not learnt; rows that repeat are predicted each; an empty table gives an
empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_broadcast, held_out, table, written

#: Characters of an n-gram, and documents of a language that it is learnt from at most: those with the smallest hash of their id.
SIZES, SAMPLE = (3, 4), 2000
#: n-grams of a language that its filter gets at most, and the least share of its n-grams and of its documents that each must be.
GRAMS, LEAST, IN_DOCS = 20_000, 1e-6, 0.002
#: Values that ids are hashed to when the sample is drawn.
SPREAD = 1 << 30
#: Places of the table (a power of two) and lookups an n-gram.
PLACES, PROBES = 1 << 20, 3
#: n-grams of all languages' filters together, at most: with very many languages each gets fewer of them.
ALL_GRAMS = 5_000_000
#: Characters that are hashed at once.
CHUNK = 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes(text: str, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams of a lower-cased text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(code) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(code) - n + 1, n, np.uint64)
    for i in range(n):
        h ^= code[i : len(code) - n + 1 + i]
        h *= MIX
        h ^= h >> np.uint64(29)
    return h


def places(h: np.ndarray) -> list[np.ndarray]:
    """Where the table is looked up for each hash."""
    return [(h >> np.uint64(64 - 20 * (i + 1))) & np.uint64(PLACES - 1) for i in range(PROBES)]


def prepared(text: str) -> str:
    return " " + " ".join(text.lower().split()) + " "


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, gram (its hash), n and docs, added up within a batch."""
    for b in batches:
        for lang, texts in b.groupby("lang").text:
            each = [np.unique(np.concatenate([hashes(prepared(t), n) for n in SIZES]), return_counts=True) for t in texts if has_letter(t)]
            if each:
                grams, at = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([c for _, c in each]))
                yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n.astype(np.int64), "docs": np.bincount(at)})


class Filters:
    """The filters of all languages: a byte a place and eight languages, and each filter's rate of false positives."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.langs = sorted(grams)
        self.planes = np.zeros((-(-len(self.langs) // 8), PLACES), np.uint8)
        for i, lang in enumerate(self.langs):
            for p in places(grams[lang].view(np.uint64)):
                self.planes[i // 8, p] |= np.uint8(1 << i % 8)
        self.false = np.array([(np.count_nonzero(self.planes[i // 8] & (1 << i % 8)) / PLACES) ** PROBES for i in range(len(self.langs))])
        self.bits = np.array([[v >> i & 1 for i in range(8)] for v in range(256)], np.int64)

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """For each language how many of the text's n-grams its filter holds, and how many n-grams there are."""
        found, n = np.zeros(8 * len(self.planes), np.int64), 0
        for at in range(0, len(text), CHUNK):
            for size in SIZES:
                h = hashes(text[at : at + CHUNK + size - 1], size)
                n += len(h)
                spots = places(h)
                for k, plane in enumerate(self.planes):
                    masks = plane[spots[0]]
                    for s in spots[1:]:
                        masks &= plane[s]
                    found[8 * k : 8 * k + 8] += np.bincount(masks, minlength=256) @ self.bits
        return found[: len(self.langs)], n

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        found, n = self.counts(prepared(text))
        true = np.maximum((found - n * self.false) / (1 - self.false), 0)
        best = int(true.argmax())
        return self.langs[best], float(true[best] / true.sum()) if true.sum() else 0.0


def train(docs: DataFrame) -> Filters:
    """Filters from SAMPLE documents a language outside the held-out fifth at most.

    Every language is learnt. What comes to the driver is bounded by ALL_GRAMS n-grams and a row a language."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # A row a language. The hashes of a frequent language's ids are held below a bound that leaves about twice the sample:
    # no task ranks more of a language than that.
    size = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = size.count()
    if not langs:
        return Filters({})
    bound = size.select(F.col("lang").alias("of_lang"), F.least(F.lit(float(SPREAD)), F.lit(float(SPREAD) * (2 * SAMPLE + 200)) / F.col("n")).alias("bound"))
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    drawn = hashed.join(bounded_broadcast(written(bound, "lang-bounds")), F.col("lang") == F.col("of_lang")).filter(F.pmod("h", F.lit(SPREAD)) < F.col("bound"))
    first = W.partitionBy("lang").orderBy(F.pmod("h", F.lit(SPREAD)), "h", "doc_id")
    ids = written(drawn.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= SAMPLE).select(F.col("doc_id").alias("of"), F.col("lang").alias("of_lang")).distinct(), "lang-sample")
    sample = rows.join(bounded_broadcast(ids, 1_000_000), (F.col("doc_id") == F.col("of")) & (F.col("lang") == F.col("of_lang"))).select("lang", "text")
    each = max(1, min(GRAMS, ALL_GRAMS // langs))
    counted = written(sample.repartition(64).mapInPandas(_counted, "lang string, gram long, n long, docs long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "lang-grams")
    every = counted.groupBy("lang").agg(F.sum("n").alias("all"), F.max("docs").alias("most"))
    top = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = counted.join(bounded_broadcast(every), "lang").filter((F.col("n") >= F.greatest(F.lit(2), LEAST * F.col("all"))) & (F.col("docs") >= IN_DOCS * F.col("most"))).withColumn("k", F.row_number().over(top)).filter(F.col("k") <= each)
    grams = kept.select("lang", "gram").toPandas()
    return Filters({lang: g.to_numpy(np.int64) for lang, g in grams.groupby("lang").gram})


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs with a struct prediction: lang_pred and score."""
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    predicted.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn("prediction", F.pandas_udf(predicted, "lang_pred string, score double")("text"))


def op7_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "prediction.lang_pred", "prediction.score")
