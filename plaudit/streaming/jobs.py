"""Structured Streaming jobs on a stream of reviews with an event time ``ts``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plaudit import config as C
from plaudit.functions.scoring import star_label
from plaudit.functions.text import clean_text, text_digest


def read_stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_table_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of a table that is one Parquet file or a folder of them, with the table's schema. The
    last character is written as a glob: a path without one must be a folder."""
    schema = spark.read.parquet(path).schema
    return read_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, "*", files_per_trigger)


def dedup_stream(reviews: DataFrame, keys: list[str], text: str | None = "comment",
                 delay: str = "1 day") -> DataFrame:
    """Drop repeats of (keys, text) that arrive within the watermark. State holds digests."""
    out, group = reviews.withWatermark("ts", delay), list(keys)
    if text:
        out = out.withColumn("__digest", text_digest(clean_text(F.col(text))))
        group.append("__digest")
    return out.dropDuplicatesWithinWatermark(group).drop("__digest")


def day_volume_stream(reviews: DataFrame, item: str = "item", delay: str = "1 day") -> DataFrame:
    """Reviews per item and day; later rows than the delay are dropped."""
    return (
        reviews.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), item)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(item, F.to_date("window.start").alias("day"), "n")
    )


def burst_stream(reviews: DataFrame, keys: list[str], at_least: int = 5, delay: str = "1 day") -> DataFrame:
    """Users who post too often about one item on one day. Written by ``write_updates`` a burst is
    there as soon as it is one, in append mode once the watermark closes the day."""
    return (
        reviews.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= at_least)
        .select(*keys, F.to_date("window.start").alias("day"), "n")
    )


def burst_sessions(reviews: DataFrame, keys: list[str], gap: str = "30 minutes", at_least: int = 5,
                   delay: str = "1 day") -> DataFrame:
    """Runs of at least ``at_least`` reviews by one user about one item, each at most ``gap``
    after the one before: the keys, ``first`` and ``last`` time, ``n``. A run over midnight is one
    burst. Works on a stream (append mode: a run is written once the watermark has passed its last
    review by ``gap``) and on a table. Null keys form a group, rows without a time none. Runs are merged in
    the map tasks first when ``merge_runs_early`` is set on the session, so that a key with many
    reviews reaches its task as a few runs."""
    rows = reviews.withWatermark("ts", delay) if reviews.isStreaming else reviews
    return (
        rows.groupBy(F.session_window("ts", gap), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
        .filter(F.col("n") >= at_least)
        .select(*keys, "first", "last", "n")
    )


def merge_runs_early(spark: SparkSession) -> None:
    """Let every map task merge its rows into runs before they are shuffled."""
    spark.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


def late_predictions(reviews: DataFrame, predictions: DataFrame, within: str = "1 day", delay: str = "1 day",
                     spam: C.SpamConfig = C.SpamConfig()) -> DataFrame:
    """Reviews (row_id, star, ts, ...) with the prediction (row_id, p_pos, scored_ts) that comes up to
    ``within`` after them, and ``rating_mismatch``, which contradicts the stars with confidence.

    Two streams are joined under watermarks on both sides, so the state holds what is younger than
    ``delay`` and ``within`` alone. A review whose prediction stays out, or comes later than that,
    gets nulls: once the watermark of both streams has passed its time. On tables every such row
    is there at once. A prediction without a review is dropped; one written twice gives two rows.
    """
    left, right = reviews, predictions.select(F.col("row_id").alias("__row_id"), "p_pos", "scored_ts")
    if reviews.isStreaming:
        left, right = left.withWatermark("ts", delay), right.withWatermark("scored_ts", delay)
    in_time = F.col("scored_ts").between(F.col("ts"), F.col("ts") + F.expr(f"INTERVAL {within}"))
    met = left.join(right, (F.col("row_id") == F.col("__row_id")) & in_time, "left").drop("__row_id")
    label, p = star_label(F.col("star")), F.col("p_pos")
    contrary = ((p >= spam.confident_positive) & (label == 0)) | ((p <= spam.confident_negative) & (label == 1))
    return met.withColumn("rating_mismatch", F.when(p.isNotNull(), F.coalesce(contrary, F.lit(False))))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet with everything that is available, then stop."""
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )


def write_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every change of a running count into a folder of its micro-batch. Nothing waits for
    the watermark, so the last days of a stream that ends are there as well; a batch that is
    replayed overwrites its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def latest_counts(spark: SparkSession, path: str, schema, keys: list[str], count: str = "n") -> DataFrame:
    """The current counts from the changes that ``write_updates`` left: counts only grow, so the
    largest one of a key is the latest."""
    changes = spark.read.schema(schema).parquet(path)
    return changes.groupBy(*keys).agg(F.max(count).alias(count))


def score_stream(reviews: DataFrame, score: Callable[[DataFrame], DataFrame], path: str,
                 checkpoint: str) -> StreamingQuery:
    """Score each micro-batch into its own folder. A batch that is replayed after a failure
    overwrites its folder, so rows are written exactly once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        reviews.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
