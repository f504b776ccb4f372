"""Corpus profile from sketches that are kept per segment and merged.

A segment's state is one row of a few kilobytes: exact counts and sums, HyperLogLog sketches of what is
counted without repeats, and a KLL sketch of the text lengths. Reviews that arrive later, or a
segment that is written again, add or replace their own row; the profile of everything is merged
from the rows, and no review is read a second time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.functions.text import text_digest
from plaudit.operators.states import StateConfig, with_segment


@dataclass(frozen=True)
class SketchConfig:
    """``log_registers`` of the HyperLogLog sketches (2^k registers) and ``k`` of the KLL sketch.
    States that are to be merged share both."""

    log_registers: int = 14
    k: int = 400
    rows_per_segment: int = 250_000

    @property
    def distinct_error(self) -> float:
        """Relative error of a distinct count that holds with a probability of about 0.997."""
        return 3 * 1.04 / math.sqrt(2**self.log_registers)

    @property
    def rank_error(self) -> float:
        """Error of a quantile's rank, as a share of all rows, that holds with a probability of
        about 0.99: 2.296 / k^0.9021, the published fit for one-sided rank queries."""
        return 2.296 / self.k**0.9021


#: What is counted without repeats: columns, and the digest of the text with or without them.
DISTINCT = {"users": ("user_id",), "item_days": ("item", "day_no"), "texts": ("__text",), "reviews": ("item", "user_id", "__text")}


def profile_states(reviews: DataFrame, cfg: SketchConfig = SketchConfig()) -> DataFrame:
    """One row per segment, in one pass with a partial aggregate in the map tasks: a row of sketches
    per task and segment is shuffled, whatever the number of reviews.

    Null texts count as empty and have no length; they and equal texts share a digest. An empty
    table gives no state."""
    chars = F.length("comment")
    rows = with_segment(reviews, StateConfig(rows_per_segment=cfg.rows_per_segment)).select(
        "segment", chars.cast("bigint").alias("chars"),
        *[_hash(columns, text_digest(F.col("comment"))).alias(name) for name, columns in DISTINCT.items()],
    )
    return rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce("chars", F.lit(0)) == 0).alias("empty_comment"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("len_sum"), F.count("chars").alias("len_count"), F.max("chars").alias("len_max"),
        F.kll_sketch_agg_bigint("chars", F.lit(cfg.k)).alias("lengths"),
        *[F.hll_sketch_agg(name, F.lit(cfg.log_registers)).alias(name) for name in DISTINCT],
    )


def _hash(columns: tuple[str, ...], digest: Column) -> Column:
    parts = [F.coalesce(digest if c == "__text" else F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return F.xxhash64(*parts)


def merged_profile(states: DataFrame) -> DataFrame:
    """One row for all segments: exact sizes and mean, estimated distinct counts, duplicates and
    length quantiles. Of the states ``n`` = 0 marks a segment without rows."""
    live = states.filter("n > 0")
    merged = live.agg(
        F.sum("n").alias("n_rows"), F.sum("empty_comment").alias("empty_comment"),
        (F.sum("len_sum") / F.sum("len_count")).alias("len_mean"), F.max("len_max").alias("len_max"),
        F.kll_merge_agg_bigint("lengths").alias("lengths"),
        *[F.hll_sketch_estimate(F.hll_union_agg(name)).alias(f"n_{name}") for name in DISTINCT],
    )
    at = {name: F.kll_sketch_get_quantile_bigint("lengths", F.lit(q)) for name, q in (("len_p50", 0.5), ("len_p90", 0.9), ("len_p99", 0.99))}
    return merged.select(
        "n_rows", "empty_comment", "len_mean", "len_max", *[F.when(F.col("n_rows") > 0, v).alias(n) for n, v in at.items()],
        *[f"n_{name}" for name in DISTINCT], F.greatest(F.lit(0), F.col("n_rows") - F.col("n_reviews")).alias("dup_global"),
    )


def errors_within(profile: DataFrame, reviews: DataFrame, cfg: SketchConfig = SketchConfig()) -> DataFrame:
    """The audit of a profile against the rows themselves: the exact figures, and whether each
    estimate is within its bound. This reads the reviews and is meant for tests and spot checks."""
    digest, chars = text_digest(F.col("comment")), F.length("comment")
    p = profile.select(F.struct("*").alias("p")).scalar()
    quantiles = {"len_p50": 0.5, "len_p90": 0.9, "len_p99": 0.99}
    ranks = reviews.select(chars.alias("chars"), p.alias("p")).agg(
        F.count("chars").alias("m"),
        *[F.count_if(F.col("chars") < F.col(f"p.{q}")).alias(f"below_{q}") for q in quantiles],
        *[F.count_if(F.col("chars") <= F.col(f"p.{q}")).alias(f"upto_{q}") for q in quantiles],
    ).select(F.struct("*").alias("r")).scalar()
    counts = [
        reviews.select(_hash(columns, digest).alias("h")).groupBy("h").count().agg(F.count(F.lit(1)).alias(f"exact_{name}")).scalar().alias(f"exact_{name}")
        for name, columns in DISTINCT.items()
    ]
    one = profile.select("*", ranks.alias("r"), *counts)
    near = [(F.abs(F.col(f"n_{n}") - F.col(f"exact_{n}")) <= F.col(f"exact_{n}") * cfg.distinct_error + 1).alias(f"{n}_ok") for n in DISTINCT]
    slack = F.col("r.m") * cfg.rank_error + 1
    rank = [
        ((F.col(f"r.below_{n}") <= F.col("r.m") * q + slack) & (F.col(f"r.upto_{n}") >= F.col("r.m") * q - slack)).alias(f"{n}_ok")
        for n, q in quantiles.items()
    ]
    return one.select("n_rows", "empty_comment", "len_mean", "len_max", *[f"exact_{n}" for n in DISTINCT], *near, *rank)
