"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words (letters lower-cased) and their leading characters, hashed to 2**BITS
buckets. On a bounded sample of labelled documents, buckets that tell the classes apart are chosen, by themselves or as
pairs: of the commonest ones, pairs that are toxic more or less often than either of both is. The
machine is then fitted: a weight a bucket and a short vector a bucket, whose products weigh pairs of terms (an
insult beside the mention of a group). All documents are scored, whole, in batches.

Defined results: null and empty texts have no terms and get the score of the bias; documents without a
label, or with a null label, are scored but never learnt from; if a document has several labels the largest
counts, and where documents tie in the hash that the sample is drawn by, the smaller id; a very long text is scored by
all its words; without labelled documents of both classes the bias alone scores, from the classes' counts; rows
that repeat are scored each; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table, written

BITS = 22
#: Labelled documents of each class that the machine is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 6000
#: Buckets that it has weights for, at most, and the least documents and deviations from chance that they need.
TERMS, LEAST, SIGMA = 8192, 4, 4.5
#: Of the commonest buckets so many are looked at in pairs, and pairs that deviate so far, up to so many, have their buckets chosen.
COMMON, PAIR_SIGMA, PAIRS = 1024, 6.0, 2048
FACTORS, EPOCHS, RATE, DECAY = 4, 30, 0.1, 2e-4
#: Bytes other than letters, digits and those of multi-byte characters separate words.
SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
PREFIXES = (4, 5, 6)
#: Words whose buckets a task keeps.
CACHE = 400_000


def words(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "replace").translate(SPACED).split())


class Buckets(dict):
    """The buckets of a word and of its leading bytes, kept while there is room."""

    def __init__(self, known: dict[int, int] | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        ids = [xxhash.xxh32_intdigest(word) >> (32 - BITS), *(xxhash.xxh32_intdigest(word[:n] + b"*") >> (32 - BITS) for n in PREFIXES if len(word) >= n)]
        found = tuple(dict.fromkeys(ids)) if self.known is None else tuple(dict.fromkeys(self.known[i] for i in ids if i in self.known))
        if len(self) > CACHE:
            self.clear()
        self[word] = found
        return found


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    of = Buckets()
    for b in batches:
        yield pd.DataFrame({"doc_id": b.doc_id, "y": b.y, "terms": [sorted({i for w in words(t) for i in of[w]}) for t in b.text]})


class Machine:
    """A fitted factorization machine: known buckets, bias, weights and vectors."""

    def __init__(self, known: dict[int, int], bias: float, w: np.ndarray, v: np.ndarray):
        self.known, self.bias, self.w, self.v = known, bias, w, v

    def logits(self, rows: list[list[int]]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for i, ids in enumerate(rows):
            if ids:
                v = self.v[ids]
                out[i] += self.w[ids].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())
        return out


def fit(rows: list[list[int]], y: np.ndarray, n_terms: int, prior: float, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors by AdaGrad on log loss; the bias is then moved from the sample's share of ones to prior."""
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, FACTORS)), 0.0
    gw, gv, gb = np.full(n_terms, 1e-6), np.full((n_terms, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS if len(rows) else 0):
        for i in rng.permutation(len(rows)):
            ids = rows[i]
            vi = v[ids]
            s = vi.sum(0)
            z = bias + w[ids].sum() + 0.5 * ((s * s).sum() - (vi * vi).sum())
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
            gb += d * d
            bias -= RATE * d / np.sqrt(gb)
            if ids:
                g = d + DECAY * w[ids]
                gw[ids] += g * g
                w[ids] -= RATE * g / np.sqrt(gw[ids])
                g = d * (s - vi) + DECAY * vi
                gv[ids] += g * g
                v[ids] -= RATE * g / np.sqrt(gv[ids])
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    return bias + np.log(prior / (1 - prior)) - np.log(share / (1 - share)), w, v


def telling_pairs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of columns of x (a row a document, 1 where it has the bucket) whose rate of ones in y lies far from the rates of
    both columns alone, the farthest first."""
    n, pos = x.T @ x, x[y > 0].T @ x[y > 0]
    own = np.diag(pos) / np.maximum(np.diag(n), 1)
    # How far the pair lies from what the nearer one of its two columns would give.
    rate = np.clip(own, 1 / (np.diag(n) + 2), 1 - 1 / (np.diag(n) + 2))
    off = [np.abs(pos - n * r) / np.sqrt(np.maximum(n * r * (1 - r), 1e-9)) for r in (rate[:, None], rate[None, :])]
    z = np.where(n >= LEAST, np.minimum(*off), 0.0)
    i, j = np.nonzero(np.triu(z >= PAIR_SIGMA, 1))
    order = np.lexsort((j, i, -z[i, j]))[:PAIRS]
    return list(zip(i[order].tolist(), j[order].tolist(), strict=True))


def pair_terms(sample: DataFrame, seen: DataFrame, size: int) -> list[int]:
    """The buckets of telling pairs among the COMMON ones that occur in some documents and not in others, without repeats."""
    common = [r["term"] for r in seen.orderBy(F.desc(F.col("n") * (size - F.col("n"))), "term").limit(COMMON).collect()]
    if not common:
        return []
    # 2 * SAMPLE rows of COMMON numbers at most.
    table = sample.select("y", F.array_intersect("terms", F.array(*map(F.lit, common))).alias("terms")).toArrow()
    own = table.column("terms").combine_chunks()
    rows = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
    order = np.argsort(common)
    x = np.zeros((len(own), len(common)), np.float32)
    x[rows, order[np.searchsorted(np.array(common)[order], own.values.to_numpy())]] = 1
    return list(dict.fromkeys(common[k] for pair in telling_pairs(x, table.column("y").to_numpy()) for k in pair))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine, fitted on SAMPLE documents of each class outside the held-out fifth at most."""
    y = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y")).filter(~held_out(F.col("doc_id")))
    count = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = float(np.clip((count.get(1, 0) + 0.5) / (sum(count.values()) + 1), 1e-4, 0.5))
    order = F.xxhash64("doc_id")
    ids = y.filter("y = 1").orderBy(order, "doc_id").limit(SAMPLE).unionAll(y.filter("y = 0").orderBy(order, "doc_id").limit(SAMPLE))
    # The limits bound what is broadcast here and collected below: 2 * SAMPLE rows, TERMS buckets a row.
    sample = written(docs.select("doc_id", "text").join(F.broadcast(ids.select(F.col("doc_id").alias("of"), "y")), F.col("doc_id") == F.col("of")).select("doc_id", "y", "text").mapInPandas(_terms, "doc_id long, y int, terms array<int>"), "toxic-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Machine({}, float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, FACTORS)))
    share = n1 / (n1 + n0)
    seen = sample.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    z = F.abs(F.col("pos") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    chosen = seen.withColumn("z", z).filter(F.col("z") >= SIGMA).orderBy(F.desc("z"), "term").limit(TERMS).select("term").collect()
    terms = dict.fromkeys([*(r["term"] for r in chosen), *pair_terms(sample, seen, n1 + n0)])
    known = {t: i for i, t in enumerate(list(terms)[:TERMS])}
    kept = F.array(*map(F.lit, known)) if known else F.array().cast("array<int>")
    rows = sample.select("y", F.array_intersect("terms", kept).alias("terms"), "doc_id").orderBy("doc_id").collect()
    bias, w, v = fit([[known[t] for t in r["terms"]] for r in rows], np.array([r["y"] for r in rows], float), len(known), prior)
    return Machine(known, bias, w, v)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with a score (double) added."""
    model = docs.sparkSession.sparkContext.broadcast((machine.known, machine.bias, machine.w, machine.v))

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Machine(*model.value)
        of = Buckets(m.known)
        for texts in batches:
            z = m.logits([list({i for w in words(t) for i in of[w]}) for t in texts])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("score", F.pandas_udf(scores, "double")("text"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    scored = score(docs.select(F.struct(*docs.columns).alias("row"), "text"), train(docs, labels))
    return scored.filter(F.col("score") < threshold).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op5_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
