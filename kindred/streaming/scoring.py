"""The row-wise operators on streams, and running confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params, schema
from ..operators.evaluate import counted, long, scored, threshold_table, transformed
from ..schema import label


def pairs_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schema.PAIRS).option("sep", "\t").csv(path)


def score_stream(pairs: DataFrame, names=("jaccard", "strike_a_match"), sorting=False) -> DataFrame:
    """Scores of each arriving pair; nothing is kept between batches."""
    return scored(transformed(pairs, sorting), names)


def confusion_stream(pairs: DataFrame, names=("jaccard", "strike_a_match"), sorting=False) -> DataFrame:
    """tp, fn, fp and tn by method so far (for complete or update mode); the state has a row a method."""
    rows = long(score_stream(pairs.withColumn("label", label(F.col("res"))), names, sorting), names, "label")
    table = F.broadcast(threshold_table(pairs.sparkSession, params.threshold_mode(sorting)))
    return counted(rows.join(table, "method").withColumn("predicted", F.col("score") >= F.col("thres")), "method")
