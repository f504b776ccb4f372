"""Keep-first over any number of batches: what was seen once never comes again, however late.

The table of seen digests lies on disk, a folder per batch. A batch meets it through a bitmap of its
own digests, which is of constant size: old digests that it cannot hold are dropped in the scan,
and the few others are joined. Batches are numbered; one that runs again after a failure reads what
the earlier ones saw and replaces what it wrote itself, so results do not depend on restarts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plaudit.functions.text import text_digest
from plaudit.operators.cleaning import dedup_keep_first
from plaudit.operators.scale import hash_bitmap, sift, stable_copy

DIGEST_BITS = 24
SEEN = "digest binary, batch long"


def _digest(keys: list[str], text: str) -> Column:
    """One digest of keys and text; lengths keep neighbours apart, a null is not an empty value."""
    parts = [F.col(c).cast("string") for c in (*keys, text)]
    shown = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return text_digest(F.concat(*shown))


def seen_digests(spark: SparkSession, path: str, before: int) -> DataFrame:
    """Digests of all batches before the given one; ``path`` need not exist yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/seen")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SEEN)
    return spark.read.schema(SEEN).parquet(f"{path}/seen").filter(F.col("batch") < before)


def unseen_rows(batch: DataFrame, seen: DataFrame, keys: list[str], text: str = "comment", row_id: str = "row_id") -> DataFrame:
    """The first row per keys and text of ``batch`` that none of ``seen`` holds, with its digest.

    ``batch`` is read twice and should be a table. First is the smallest ``row_id``; rows that
    repeat an older batch go, whatever their ids.
    """
    mine = dedup_keep_first(batch, tuple(keys), text, row_id).withColumn("digest", _digest(keys, text))
    key = F.xxhash64("digest")
    bitmap = hash_bitmap(batch.select(_digest(keys, text).alias("digest")), key, DIGEST_BITS)
    old = sift(seen.select("digest"), key, bitmap, DIGEST_BITS)
    return mine.join(old, "digest", "left_anti")


def append_unseen(batch: DataFrame, number: int, path: str, keys: list[str], text: str = "comment", row_id: str = "row_id") -> None:
    """Write the new rows of batch ``number`` to ``path``/rows and their digests to ``path``/seen.

    The rows go first: a batch that fails in between runs again under its number and replaces
    both, as its own digests do not count for it. The digests are those of the rows as written.
    """
    spark = batch.sparkSession
    held = stable_copy(batch)
    fresh = unseen_rows(held, seen_digests(spark, path, number), keys, text, row_id)
    target = f"{path}/rows/batch={number}"
    fresh.write.mode("overwrite").parquet(target)
    written = spark.read.schema(fresh.schema).parquet(target)
    written.select("digest").write.mode("overwrite").parquet(f"{path}/seen/batch={number}")


def kept_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows that any batch kept, with the batch that brought them."""
    return spark.read.parquet(f"{path}/rows").drop("digest")


def unseen_stream(reviews: DataFrame, path: str, checkpoint: str, keys: list[str], text: str = "comment", row_id: str = "row_id") -> StreamingQuery:
    """Everything that is available goes through ``append_unseen``, batch by batch, then it stops.
    The checkpoint numbers the batches; started again with it, the stream goes on where it was."""

    def one(batch: DataFrame, number: int) -> None:
        append_unseen(batch, number, path, keys, text, row_id)

    return reviews.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
