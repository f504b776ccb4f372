"""Sources: the raw CSV, clean reviews, prediction shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.operators.spam import day_number
from plaudit.sources.csv_blocks import read_csv_blocks

RAW_SCHEMA = T.StructType(
    [
        T.StructField("ID", T.LongType()),
        T.StructField("Movie_Name_EN", T.StringType()),
        T.StructField("Movie_Name_CN", T.StringType()),
        T.StructField("Crawl_Date", T.StringType()),
        T.StructField("Number", T.IntegerType()),
        T.StructField("Username", T.StringType()),
        T.StructField("Date", T.StringType()),
        T.StructField("Star", T.IntegerType()),
        T.StructField("Comment", T.StringType()),
        T.StructField("Like", T.IntegerType()),
    ]
)

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("item", T.StringType()),
        T.StructField("star", T.IntegerType()),
        T.StructField("likes", T.IntegerType()),
        T.StructField("p_pos", T.DoubleType()),
        T.StructField("pred_sent", T.IntegerType()),
        T.StructField("exp_rating", T.DoubleType()),
        T.StructField("pred_rating", T.IntegerType()),
        T.StructField("p_rating", T.DoubleType()),
    ]
)


def read_raw_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw reviews with a fixed schema. Quoted line breaks need ``multi_line``, which stores the
    lines once in chunks (``csv_blocks``); a file is read by many tasks either way. Columns that
    are not selected later are not parsed."""
    if multi_line:
        return read_csv_blocks(spark, path, RAW_SCHEMA)
    return (
        spark.read.schema(RAW_SCHEMA)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def as_reviews(raw: DataFrame) -> DataFrame:
    """The seven used columns under the names the operators expect. ``ID`` is the row id: Spark
    has no file order, so the key must be in the data."""
    return raw.select(
        F.col("ID").alias("row_id"),
        F.col("Movie_Name_CN").alias("item"),
        F.col("Movie_Name_EN").alias("item_label"),
        F.col("Username").alias("user_id"),
        day_number(F.col("Date")).alias("day_no"),
        F.col("Star").alias("star"),
        F.coalesce(F.col("Like"), F.lit(0)).alias("likes"),
        F.col("Comment").alias("comment"),
    )


def read_predictions(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All shards of a prediction folder as one table, pruned to ``columns``."""
    df = spark.read.schema(PREDICTION_SCHEMA).parquet(path)
    return df.select(*columns) if columns else df


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet side table, or None if it has not been written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(hadoop) else None
