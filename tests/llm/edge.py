"""Rows that every operator has to take: nulls, empty and long texts, repeats, extra columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} and line{i}" for i in range(30_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\r ", "en", "a", 5), (4, "12 34 !!", "en", "b", 8),
    (5, LONG, "en", "b", len(LONG)), (6, "one", "en", None, 3), (7, "the same text twice over here today", "en", "a", 35),
    (7, "the same text twice over here today", "en", "a", 35), (8, "the same text twice over here today", "en", "a", 35),
    (None, "no id but words are here for you", "en", "b", 32), (9, "Ünï çödé \U0001f600 tëxt", "de", "c", 15), (10, "a\x00b ퟿ c", "fr", "c", 7),
]


def documents(spark):
    """The rows with extra columns whose names operators might use."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("_row", "_text", "_t1", "size", "hub", "sig", "toxic", "_copies", "_r_doc_id", "_taken", "position"):
        df = df.withColumn(name, F.lit(name))
    return df.select("*", F.lit("dotted").alias("a.b"), F.create_map(F.lit("k"), F.lit(1)).alias("tags"), F.lit("parts").alias("parts"))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
