"""Documents with all that may go wrong: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 3000

ROWS = [
    (1, "one two three four five six seven"),
    (2, "one two  three\tfour five six seven"),
    (2, "one two  three\tfour five six seven"),
    (None, "one two three four five six seven"),
    (None, None),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, LONG),
    (8, "Ünïcödé 日本語 \U0001f600 text İstanbul <|endoftext|> \x1c \xa0 end"),
    (9, "x"),
    (10, "a" * 50_000),
]
CLASHING = ("digest", "row", "bucket", "node", "key", "shard", "first", "word", "n", "text_hash", "length", "label", "score", "kept", "id")


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(f"own {c}").alias(c) for c in CLASHING]).repartition(3)


def empty(spark):
    return docs(spark, [])


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}
