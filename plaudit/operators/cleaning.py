"""Cleaning, deduplication, item dimension and corpus profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions.text import clean_text, text_digest
from plaudit.operators.scale import attach_group_values, compute_once, dense_index


def clean_reviews(raw: DataFrame, cfg: C.CleanConfig = C.CleanConfig()) -> DataFrame:
    """Clean ``comment`` and keep rows that are long enough and have a valid star."""
    present = raw.filter(F.col("comment").isNotNull())
    if cfg.na_tokens:
        present = present.filter(~F.col("comment").isin(*cfg.na_tokens))
    cleaned = compute_once(present, "comment", clean_text(F.col("comment")))
    return cleaned.filter(
        (F.length("comment") >= cfg.min_chars) & F.col("star").between(cfg.min_star, cfg.max_star)
    )


def dedup_keep_first(
    reviews: DataFrame, keys: tuple[str, ...] = ("item", "user_id"), text: str = "comment",
    row_id: str = "row_id",
) -> DataFrame:
    """Of the rows with the same keys and text, keep the one with the smallest row id.

    Grouping runs on a digest and shuffles no text; only groups with copies reach the join.
    """
    marked = reviews.withColumn("__digest", text_digest(F.col(text)))
    group = [*keys, "__digest"]
    copies = (
        marked.groupBy(*group)
        .agg(F.min(row_id).alias("__first"), F.count(F.lit(1)).alias("__copies"))
        .filter(F.col("__copies") > 1)
    )
    found = attach_group_values(
        marked, copies, group, "__copies", [row_id], keep=lambda g: F.col(row_id) == g["__first"]
    )
    return found.select(*reviews.columns)


def item_dimension(raw: DataFrame, name: str = "item", label: str = "item_label",
                   row_id: str = "row_id") -> DataFrame:
    """Distinct items with their first label and dense ids by name, from unfiltered rows."""
    # The first step has plain numbers in its buffers and reduces in the map tasks.
    pairs = raw.groupBy(name, label).agg(F.min(row_id).alias("__first"))
    first = pairs.groupBy(name).agg(F.min_by(label, "__first").alias(label))
    return dense_index(first, [name], "item_id").select("item_id", name, label)


def map_item_ids(reviews: DataFrame, items: DataFrame, name: str = "item",
                 row_id: str = "row_id") -> DataFrame:
    """Item id by name, -1 when unknown."""
    sizes = reviews.groupBy(name).agg(F.count(F.lit(1)).alias("__rows"))
    dim = sizes.join(items.select(name, "item_id"), name, "left").withColumn(
        "item_id", F.coalesce(F.col("item_id"), F.lit(-1))
    )
    return attach_group_values(reviews, dim, [name], "__rows", [row_id]).drop("__rows")


def first_rows(reviews: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    """The row limit of a trial run."""
    return reviews.orderBy(row_id).limit(n)


def corpus_profile(reviews: DataFrame, lengths_of: str = "comment",
                   dedup_keys: tuple[str, ...] = ("item", "user_id")) -> DataFrame:
    """One row: sizes, duplicates, empty comments, item counts and length quantiles.

    Quantiles run over (length, frequency), so the buffer holds distinct lengths only.
    """
    text = F.col(lengths_of)
    by_length = reviews.groupBy(F.length(text).alias("chars")).agg(
        F.count(F.lit(1)).alias("freq")
    )
    lengths = by_length.agg(
        F.sum("freq").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.coalesce(F.col("chars"), F.lit(0)) == 0, F.col("freq"))), F.lit(0))
        .alias("empty_comment"),
        (F.sum(F.col("chars") * F.col("freq")) / F.sum(F.when(F.col("chars").isNotNull(), F.col("freq"))))
        .alias("len_mean"),
        F.percentile("chars", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), F.col("freq")).alias("q"),
        F.max("chars").alias("len_max"),
    )
    by_item = reviews.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    items = by_item.agg(
        F.struct(
            F.count(F.lit(1)).alias("n_items"),
            F.count_if(F.col("n") >= 100).alias("items_ge100"),
            F.count_if(F.col("n") >= 1000).alias("items_ge1000"),
            F.count_if(F.col("n") < 10).alias("items_lt10"),
        ).alias("i")
    ).scalar()
    copies = (
        reviews.groupBy(*dedup_keys, text_digest(text).alias("__d"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum(F.col("n") - 1).alias("dup_global"))
    )
    return lengths.select(
        "n_rows",
        items["n_items"].alias("n_items"),
        copies.scalar().alias("dup_global"),
        "empty_comment",
        "len_mean",
        F.col("q")[0].alias("len_p50"),
        F.col("q")[1].alias("len_p90"),
        F.col("q")[2].alias("len_p99"),
        "len_max",
        items["items_ge100"].alias("items_ge100"),
        items["items_ge1000"].alias("items_ge1000"),
        items["items_lt10"].alias("items_lt10"),
    )


def star_histogram(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("star").agg(F.count(F.lit(1)).alias("n"))


def largest_items(reviews: DataFrame, n: int = 20) -> DataFrame:
    counts = reviews.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "item").limit(n)
