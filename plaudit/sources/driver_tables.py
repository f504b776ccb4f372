"""The given tables seen as reviews: documents are the reviews, sources the items, labels the
stars, exact copies share their user and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit import config as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Text work is heavy per row, and a small file is one task. Inputs with fewer splits than
    twice the cores are spread by key; large inputs stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < 2 * cores else df


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_small(table(spark, sf_dir, "documents"), "doc_id")
    labels = table(spark, sf_dir, "labels")
    star = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 5)
        .when(F.col("quality") == 1, 4)
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), 2)
        .when(F.col("quality") == 0, 1)
        .otherwise(3)
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("item"),
        F.col("lang").alias("item_label"),
        (F.col("n_chars") % 97).alias("user_id"),
        (F.col("n_chars") % 14).cast("int").alias("day_no"),
        star.alias("star"),
        ((F.col("doc_id") * 37) % 400).cast("int").alias("likes"),
        F.col("text").alias("comment"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned timestamp (UTC session), as streams need it."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# Word lists and parameters that fit the invented words of the tables.
SENTIMENT = C.SentimentLexicon(
    positive=tuple("the for est que from las les ment".split()),
    negative=tuple("und der die and with des was eau".split()),
    whole_words=True,
)
ASPECTS = C.AspectConfig(
    lexicon={
        "alpha": ("that", "this", "thor"),
        "beta": ("tion", "ment"),
        "gamma": ("eau", "eux"),
        "delta": ("sch", "ung"),
        "epsilon": ("and", "with"),
        "zeta": ("que", "los"),
        "eta": ("THE",),
    },
    clause_pattern=r'[,.!?;:\n\r\t()"~-]+',
    min_mentions=5,
    positive_rate=0.57,
    negative_rate=0.36,
)
KEYWORDS = C.KeywordConfig(stop_words=("the", "and", "und", "les"))
SPAM = C.SpamConfig(burst_min=2, bomb_likes=200, bomb_chars=40)
