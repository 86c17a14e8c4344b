"""Small documents tables for the tests of this folder."""

ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, None, 0),
    (None, "no id at all", "en", "a", 12),
    (None, None, None, None, None),
    (3, "word " * 30_000, "en", "b", 150_000),
    (4, "same text here for all of us", "en", "a", 5),
    (4, "same text here for all of us", "en", "a", 5),
    (5, "same text here for all of us", "de", "b", 5),
    (6, "  \n\t ", "fr", "\U0001f600", 5),
    (7, "éàü ß İ K ſ 中文 \x1c \x85", "fr", "", 5),
]


def documents(spark, rows=ODD):
    """With columns whose names clash with those that the operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("key", F.lit("k")).withColumn("score", F.lit(1)).withColumn("row", F.lit(2)).withColumn("copies", F.lit(3)).withColumn("blob", F.lit("b"))


def put(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
