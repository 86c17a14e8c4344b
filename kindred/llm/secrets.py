"""Secret scans over an incremental ledger of blobs.

Every version of a text is a blob named by its SHA-256. The ledger holds, for each blob and rule version
already scanned, the spans found. A scan takes only blobs that the ledger lacks for this rule version, one
document standing for all its copies, appends them, and joins findings back to every document.

Defined results: a null text is the empty blob; a very long text is one blob, scanned whole; spans that start
together stand in the order of KINDS; rows that repeat, or have a null id, get the findings of
their blob each; an empty table adds nothing to the ledger. Further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import bounded_broadcast, shared_path, table

RULES_VERSION = 1
#: Base kinds in the order that settles ties; then kinds of this library's own.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "forge", "jwt", "pem", "url")
RULES = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I),
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    "forge": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{32,}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
    "url": re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,128}@[^\s/]+"),
}
#: A text without any of these strings holds no match of the rule.
NEEDS = {"access": ("AKIA",), "forge": ("gh", "glpat-", "xox", "sk-"), "jwt": ("eyJ",), "pem": ("PRIVATE KEY-----",), "url": ("://",)}
SPANS = "spans array<struct<kind: string, start: int, `end`: int>>"
LEDGER = f"blob string, rules int, {SPANS}"


def spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points, end exclusive) of all matches in a text, by start, then kind."""
    found = []
    for rank, kind in enumerate(KINDS):
        if kind in NEEDS and not any(x in text for x in NEEDS[kind]):
            continue
        for m in RULES[kind].finditer(text):
            if kind != "assign" or m.end(2) - m.start(2) >= 6:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"blob": b.blob, "rules": RULES_VERSION, "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in b.text]})


def blobs(docs: DataFrame) -> DataFrame:
    """doc_id, text (no null) and blob of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("blob"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path; an empty one if nothing is there yet."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan(docs: DataFrame, ledger: str) -> DataFrame:
    """doc_id, blob and spans of every document; the ledger at this path gains the blobs that it lacked."""
    spark = docs.sparkSession
    rows = blobs(docs)
    known = read_ledger(spark, ledger).filter(F.col("rules") == RULES_VERSION).select("blob")
    unseen = rows.groupBy("blob").agg(F.min(F.struct("doc_id")).alias("first")).join(known, "blob", "left_anti").select(F.col("blob").alias("new"), F.col("first.doc_id").alias("by"))
    # Texts move by document, never by blob: copies of one text do not meet in one task.
    todo = rows.join(unseen, rows.doc_id.eqNullSafe(unseen.by) & (rows.blob == unseen.new), "left_semi")
    todo.select("blob", "text").mapInPandas(_scanned, LEDGER).dropDuplicates(["blob"]).write.mode("append").option("compression", "zstd").parquet(ledger)
    found = read_ledger(spark, ledger).filter((F.col("rules") == RULES_VERSION) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select("blob", "spans")
    return rows.select("doc_id", "blob").join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS.partition(" ")[2])).alias("spans"))


def joined(found):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@F.pandas_udf(StringType())
def _redacted(texts: pd.Series, found: pd.Series) -> pd.Series:
    out = []
    for text, marks in zip(texts, found, strict=True):
        kept, at = [], 0
        for mark in marks.split(","):
            kind, start, end = mark.split(":")
            if int(end) > at:
                kept += [text[at : max(at, int(start))], f"[{kind}]" if int(start) >= at else ""]
                at = int(end)
        out.append("".join(kept) + text[at:])
    return pd.Series(out)


def redact(docs: DataFrame, ledger: str) -> DataFrame:
    """docs with each secret's span replaced by its kind in brackets; all other rows and columns unchanged."""
    found = scan(docs, ledger).filter(F.size("spans") > 0).select(F.struct("blob", joined(F.col("spans")).alias("spans")).alias("__found")).dropDuplicates(["__found"])
    rows = docs.join(bounded_broadcast(found), F.sha2(F.coalesce(docs.text, F.lit("")).cast("binary"), 256) == F.col("__found.blob"), "left")
    clean = rows.filter(F.col("__found").isNull()).drop("__found")
    return clean.unionByName(rows.filter(F.col("__found").isNotNull()).withColumn("text", _redacted("text", "__found.spans")).drop("__found"))


def op6_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents"), shared_path(spark, "secret-ledger")))
