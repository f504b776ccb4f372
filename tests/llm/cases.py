"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows and
extra columns whose names clash with those that the operators add."""

from pyspark.sql import types as T

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, th int, id string, "
    "pieces string, runs string, removed_words string, host string, bucket int, n_words string, kept string, size string"
)
LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))
PLAIN = "One plain text of a few words. It has two lines.\nThis is the second of them, and it ends here."


def rows():
    texts = [
        (1, PLAIN), (2, PLAIN), (2, PLAIN), (3, ""), (4, None), (None, PLAIN), (None, None), (5, LONG), (6, " \n\t "),
        (7, "one"), (8, "Éa ñu 漢字 😀 ende.\n\nÉa"), (2, "another text under an old id"), (9, "### *** %%%\n### *** %%%\n!!! A B C"),
    ]
    return [
        (i, t, (None, "en", "de")[k % 3], (None, "a", "b")[k % 3], None if t is None else len(t), 0.5, 1, "x", "p", "r", "q", "h", 1, "n", "k", "s")
        for k, (i, t) in enumerate(texts)
    ]


def edge_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], T._parse_datatype_string("doc_id long, text string"))
