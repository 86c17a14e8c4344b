"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 50_000

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The stand-in for a shared folder, made when first needed.
_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is missing, a temporary folder stands in for it on one machine; a cluster must have it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own.get("root")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own["root"] = tempfile.mkdtemp(prefix="kindred-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to the shared folder and read again, so that lineage ends here."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it has at most `rows` rows, else df as it is.

    Without the hint Spark sorts and merges, and adaptive execution splits hot keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows: texts can be long, and Python's copies of them take more room than Arrow's."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn labels from (null ids count as 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
