"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing names."""

from pyspark.sql import functions as F

LONG = "the quick brown fox jumps over the lazy dog and runs away from it all " * 3000


def edge_documents(spark):
    rows = [
        (1, "", "en", "a"),
        (2, None, None, None),
        (None, "some words that have no id at all", "en", "a"),
        (3, "   \n\t ", "fr", ""),
        (4, "!!! ??? 123", "fr", "b"),
        (5, LONG, "en", "a"),
        (6, "one two three", "en", "a"),
        (7, "ONE, two; three", None, "c"),
        (8, "été à la plage avec des amis et un chien \U0001f600 𝔘𝔫𝔦", "fr", "b"),
        (8, "été à la plage avec des amis et un chien \U0001f600 𝔘𝔫𝔦", "fr", "b"),
        (9, "tie tie tie tie tie tie tie tie tie tie", "en", "a"),
        (9, "another text of the same id", "en", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("n_words", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("rule", F.lit(1))
