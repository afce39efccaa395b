"""Small awkward tables that every operator must survive."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LOREM = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old tree near town"


def edge_rows():
    return [
        (1, LOREM, "en", "b", 10), (2, LOREM, "en", "b", 10), (2, LOREM, "en", "b", 10), (3, None, None, None, None),
        (4, "", "en", "", 0), (None, "words without an id at all but long enough to be kept around", "en", "a", 1),
        (5, " \t\n\x0b\x0c\r ", "en", "é", 7), (6, "one", None, "a", 3), (7, "one two", None, "a", 3),
        (8, "x" * 50_000, "en", "c", 50_000), (9, ("long words here again and again\n" * 4000), "en", "c", 1),
        (10, "é" * 30 + " ñandú 漢字 🎉🎉  nbsp em \u0000nul", "xx", "c", 4), (11, LOREM + " end", "en", "d", 1),
        (12, LOREM.upper(), "en", "a", 2), (-5, "a b c d e f g h i j k l m", "en", None, 0),
    ]


def edge(spark):
    """The awkward rows, with an extra column and one whose name clashes with results."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(edge_rows(), SCHEMA).withColumn("size", F.lit("mine")).withColumn("_row", F.lit(1)).withColumn("_text", F.lit("x"))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def save(spark, rows, folder):
    """A documents table that queries can be pointed at."""
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)
