"""Readers and writers of pair files, gazetteer dumps, term lists and result files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..params import EVALUATED, TERM_DECISIONS


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: The stand-in for a shared folder, made when first needed.
_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir); a temporary folder on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own.get("root")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own["root"] = tempfile.mkdtemp(prefix="kindred-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Splits of files whose starts are broadcast, at most.
SPLITS = 2_000_000


def numbered(spark: SparkSession, path: str, columns: str, **options: str) -> DataFrame:
    """row and columns of a tab-separated file: rows are numbered from 0 in the order of the file, files of a folder by name.

    Rows count up within a split of a file, as tasks read it. A first look at the files counts the rows of each split;
    their running sum (a row a split) is where a split begins, so no row moves, and no order of all rows is made."""
    rows = spark.read.schema(columns).options(sep="\t", **options).csv(path)
    names = rows.columns
    # The number in the task is settled before anything filters.
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    splits = rows.groupBy("__file", "__start").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__file", "__start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = shared_path(spark, "splits")
    splits.select("__file", "__start", (before - F.col("__first")).alias("__shift")).write.parquet(found)
    splits = spark.read.schema("__file string, __start long, __shift long").parquet(found)
    splits = F.broadcast(splits) if splits.count() <= SPLITS else splits
    return rows.join(splits, ["__file", "__start"]).select((F.col("__at") + F.col("__shift")).alias("row"), *names)


def read_pairs(spark: SparkSession, path: str, with_rows: bool = False) -> DataFrame:
    """Tab-separated pairs without a header; rows that lack a string or the label are left out (but have their numbers)."""
    quoted = {"quote": '"', "escape": '"'}
    df = numbered(spark, path, schema.PAIRS, **quoted) if with_rows else spark.read.schema(schema.PAIRS).options(sep="\t", **quoted).csv(path)
    return df.dropna(subset=["s1", "s2", "res"])


def rejected_pairs(spark: SparkSession, path: str) -> int:
    """How many rows read_pairs leaves out."""
    return spark.read.schema(schema.PAIRS).option("sep", "\t").option("quote", '"').option("escape", '"').csv(path).filter("s1 IS NULL OR s2 IS NULL OR res IS NULL").count()


def read_gazetteer(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Those of the dumps that are there."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        raise FileNotFoundError(f"none of {', '.join(paths)}")
    return spark.read.schema(schema.GAZETTEER).option("sep", "\t").option("quote", "").csv(there)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The nine fields of raw tab-separated lines that have just nine."""
    fields = F.split("value", "\t")
    names = [c.split()[0] for c in schema.PAIRS.split(", ")]
    return spark.read.text(path).filter(F.size(fields) == 9).select(*(fields[i].alias(n) for i, n in enumerate(names)))


def frequent_terms(spark: SparkSession, pattern: str, n: int = 200) -> DataFrame:
    """gram_type (tokens or chars), term, and rank over the first n terms of each file by count, then term."""
    df = spark.read.schema(schema.TERMS).option("sep", "\t").option("header", True).csv(pattern).withColumn("file", F.input_file_name())
    kind = F.when(F.element_at(F.split("file", "/"), -1).contains("token"), "tokens").otherwise("chars")
    top = df.withColumn("k", F.row_number().over(W.partitionBy("file").orderBy(F.desc("no"), "term"))).filter(F.col("k") <= n)
    terms = top.groupBy(kind.alias("gram_type"), "term").agg(F.max("no").alias("no"))
    return terms.withColumn("rank", F.row_number().over(W.partitionBy("gram_type").orderBy(F.desc("no"), "term")))


def _first_line(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).filter("value <> ''").first()
    return first["value"].split("\t") if first else []


def read_decisions(spark: SparkSession, path: str, metrics=EVALUATED) -> DataFrame:
    """row, real, a column a metric, and the transformed strings a and b.

    A file with a header, as write_decisions puts it, names its metrics and has the rows' numbers. One without has a line a row:
    real, the decisions of the given metrics (sorted runs add the two term metrics), and the strings."""
    first = _first_line(spark, path)
    if first[:1] == ["row"]:
        return spark.read.schema(", ".join(f"`{c}` {'long' if c == 'row' else 'string'}" for c in first)).options(sep="\t", header=True).csv(path)
    names = [*metrics, *TERM_DECISIONS] if len(first) == len(metrics) + len(TERM_DECISIONS) + 3 else [*metrics]
    return numbered(spark, path, ", ".join(f"{c} string" for c in ("real", *names, "a", "b")))


def metrics_of(decisions: DataFrame) -> list[str]:
    return [c for c in decisions.columns if c not in ("row", "s1", "s2", "real", "a", "b")]


def write_decisions(decisions: DataFrame, path: str) -> None:
    """Decisions of numbered pairs, with a header."""
    write_tsv(decisions, path, header=True)


def in_order(outcomes: DataFrame) -> DataFrame:
    """Outcomes whose second half stands first in their file, as two-fold trials write them, with the rows that they belong to."""
    n = F.lit(outcomes.count())
    half = (n / 2).cast("long")
    return outcomes.withColumn("row", F.when(F.col("row") >= half, F.col("row") - half).otherwise(F.col("row") + n - half))


def read_outcomes(spark: SparkSession, path: str, halves: bool = False) -> DataFrame:
    """row, res1 (truth) and res2 (prediction) of a file with a header that has the rows, or without one and a line a row."""
    if _first_line(spark, path)[:1] == ["row"]:
        return spark.read.schema("row long, res1 boolean, res2 boolean").options(sep="\t", header=True).csv(path)
    df = numbered(spark, path, "res1 boolean, res2 boolean")
    return in_order(df) if halves else df


def write_tsv(df: DataFrame, path: str, header: bool = False, by: str | tuple[str, ...] | None = None) -> None:
    w = df.write.mode("overwrite").option("sep", "\t").option("header", header)
    (w.partitionBy(*([by] if isinstance(by, str) else by)) if by else w).csv(path)


def term_export(split: DataFrame) -> DataFrame:
    """res, both strings and their base, mismatching and special terms, comma-joined; split has s1, s2, res and terms."""
    part = lambda g, side: F.array_join(F.col("terms")[g][side], ",").alias(f"{g}_{'s1' if side == 'a' else 's2'}")
    side = lambda s, k: [F.col(s).alias(f"str{s[1]}"), *(part(g, k) for g in ("base", "mismatch", "special"))]
    return split.select("res", *side("s1", "a"), *side("s2", "b"))
