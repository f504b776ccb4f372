"""From raw documents to packed training batches, in five stages.

Every stage takes null, empty and very long texts, null ids, ties, repeated rows and empty tables.
Columns other than those of documents pass through, whatever they are called: what a stage works
out for itself has names that the table does not have. ``text`` and ``n_chars`` change with the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit.llm import jaccard_join, line_dedup, mixing, packing, quality_crf
from plaudit.llm.common import WORD, bounded_batches, free_name, shared_folder, table, text_of


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line classifier, trained on the labels, finds bad. A null text
    is judged as an empty one."""
    bounded_batches(spark, 8)
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    own = {c: free_name(docs, f"__{c}") for c in ("score", "predicted", "n_lines", "bad_lines")}
    return quality_crf.score(docs, model, names=own).filter(F.col(own["predicted"]) == 1).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated passages; a document goes if nothing else was in it. Documents of which
    nothing was taken stay, empty ones and null ones too."""
    bounded_batches(spark, 8)
    removed = free_name(docs, "__removed")
    cut = line_dedup.dedup_lines(docs, into=removed)
    return cut.filter((F.col(removed) == 0) | text_of().rlike(WORD)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near copies."""
    bounded_batches(spark, 8)
    return jaccard_join.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: pieces of documents, taken as often as the weights of their sources ask."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch plan of all pieces."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: Learned scores, winnowing, sampling and dynamic programming have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
