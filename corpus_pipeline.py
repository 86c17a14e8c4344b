"""A corpus from documents to token ids: STAGES in order, each on all that the one before kept.

Stages take rows with null columns, empty texts, repeated rows, empty tables and further columns as the
operators that they call do (see their modules); all but the last return the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import bpe, dedup, mixing, secrets, toxicity
from kindred.llm.common import shared_path, table, written


#: Characters of a block of the last stage: executors that have run four stages before have less memory to spare.
BLOCK = 8_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, learnt from labels of other documents' fifths, does not take for toxic."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates (similarity of 0.8 or more)."""
    return dedup.deduplicated(docs, dedup.AT_80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; the spans of secrets are replaced by their kinds."""
    return secrets.redact(docs, shared_path(spark, "secret-ledger"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' budgets take them."""
    return mixing.mixed_documents(docs)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digests of ids and of the bytes that they decode to."""
    return bpe.digest(bpe.decode(bpe.encode(docs, block=BLOCK)), "packed").withColumnRenamed("packed", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_ids),
]

#: Learnt models and hashes of word sets can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
