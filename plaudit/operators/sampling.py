"""Deterministic splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions.scoring import split_bucket, split_name, spread_hash
from plaudit.operators.scale import sample_per_group


def with_split(reviews: DataFrame, cfg: C.SplitConfig = C.SplitConfig(),
               row_id: str = "row_id") -> DataFrame:
    return reviews.withColumn("bucket", split_bucket(F.col(row_id), cfg.buckets)).withColumn(
        "split", split_name(F.col(row_id), cfg)
    )


def with_key_split(reviews: DataFrame, keys: list[str],
                   cfg: C.SplitConfig = C.SplitConfig()) -> DataFrame:
    """The same split from a hash of natural keys, for tables without a stable numeric id."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(cfg.buckets)).cast("int")
    name = F.when(bucket < cfg.val_below, "val").when(bucket < cfg.train_below, "train")
    return reviews.withColumn("bucket", bucket).withColumn("split", name.otherwise("rest"))


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def sample_reviews_per_item(reviews: DataFrame, n: int = 4000, seed: int = 42,
                            item: str = "item", row_id: str = "row_id") -> DataFrame:
    return sample_per_group(reviews, [item], row_id, n, seed)


def sample_texts(reviews: DataFrame, target: int = 300_000, per_block: int = 15_000,
                 block_rows: int = 100_000, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """Spread sample: at most ``per_block`` rows per block of row ids and ``target`` in all, chosen
    by the seeded hash over all blocks. Both cuts are found in histograms of the hash, and a row
    beyond one is dropped in the scan."""
    blocks = reviews.withColumn("__block", F.floor(F.col(row_id) / block_rows)).withColumn("__all", F.lit(0))
    part = sample_per_group(blocks, ["__block"], row_id, per_block, seed)
    ids = sample_per_group(part.select("__all", row_id), ["__all"], row_id, target, seed).select(row_id)
    return reviews.join(ids, row_id, "left_semi")


def random_subset(reviews: DataFrame, n: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """``n`` rows without replacement, the same ones on every run. Only ids are sorted."""
    ids = reviews.select(row_id).orderBy(spread_hash(F.col(row_id), seed), row_id).limit(n)
    return reviews.join(ids, row_id, "left_semi")
