"""Counts of reviews at several levels of detail from one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("item", "star", "pred_sent")
#: Item rows, the site's total, and both distributions, per item and for the site.
LEVELS = (("item",), (), ("item", "star"), ("item", "pred_sent"), ("star",), ("pred_sent",))


def review_cube(scored: DataFrame, levels: Sequence[Sequence[str]] = LEVELS, dimensions: Sequence[str] = DIMENSIONS,
                sums: Sequence[str] = ("likes", "p_pos")) -> DataFrame:
    """A row per combination at every level: the dimensions (null where the level leaves them out),
    ``grouping_id`` (a bit per dimension, the first one highest, set where it is left out; it
    tells such a null from one in the data), ``n`` and a sum ``<name>_sum`` per summed column.

    The reviews are read once and aggregated by all dimensions, partly in the map tasks; only those
    rows, a handful per item, are multiplied by the levels."""
    wrong = {c for level in levels for c in level} - set(dimensions)
    if wrong:
        raise ValueError(f"unknown dimensions {sorted(wrong)}")
    finest = scored.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__{c}") for c in sums])
    grouped = finest.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in dimensions])
    out = grouped.agg(F.grouping_id().cast("bigint").alias("grouping_id"), F.sum("__n").alias("n"), *[F.sum(f"__{c}").alias(f"{c}_sum") for c in sums])
    return out.select(*dimensions, "grouping_id", "n", *[f"{c}_sum" for c in sums])


def level_of(cube: DataFrame, level: Sequence[str], dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """The rows of one level, without the dimensions that it leaves out."""
    left_out = sum(1 << (len(dimensions) - 1 - i) for i, c in enumerate(dimensions) if c not in level)
    return cube.filter(F.col("grouping_id") == left_out).drop("grouping_id", *[c for c in dimensions if c not in level])


def shares(cube: DataFrame, by: str, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """``item, <by>, n, share``: the distribution of one dimension inside every item."""
    total = level_of(cube, ("item",), dimensions).select(F.col("item").alias("__item"), F.col("n").alias("__total"))
    part = level_of(cube, ("item", by), dimensions)
    return part.join(total, F.col("item").eqNullSafe(F.col("__item"))).select("item", by, "n", (F.col("n") / F.col("__total")).alias("share"))
