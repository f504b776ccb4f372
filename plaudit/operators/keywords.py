"""Keywords by log-odds with an informative Dirichlet prior."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.operators.scale import attach_group_values, stable_copy, top_per_group
from plaudit.operators.segmentation import corpus_tokenizer


def word_bags(reviews: DataFrame, cfg: C.KeywordConfig = C.KeywordConfig(),
              tokenize: Callable[[Column], Column] | None = None) -> DataFrame:
    """Counts per item and word in the reviews judged good (``y``) and bad (``x``).

    Runs of ideographs are cut by a dictionary mined from ``reviews``, which are read once more
    for it. ``tokenize`` maps the text column to an array column in its place: the n-grams of
    ``word_tokens``, a segmenter over a stored dictionary, or any other.
    """
    if tokenize is None:
        tokenize = corpus_tokenizer(reviews, cfg.segments)
    words = reviews.select("item", "pred_sent", F.explode(tokenize(F.col("comment"))).alias("word"))
    kept = words.filter(F.length("word") >= cfg.min_chars)
    if cfg.stop_words:
        kept = kept.filter(~F.col("word").isin(*cfg.stop_words))
    return kept.groupBy("item", "word").agg(
        F.count_if(F.col("pred_sent") == 1).alias("y"),
        F.count(F.when(~F.coalesce(F.col("pred_sent") == 1, F.lit(False)), F.lit(1))).alias("x"),
    )


def log_odds(bags: DataFrame, cfg: C.KeywordConfig = C.KeywordConfig()) -> DataFrame:
    """z-score per item and word; the prior is the word's share of all items' words.

    The bags are already one row per (item, word). Word and item totals come from them and
    return through size-aware joins, because one word can occur in every item and one item
    can hold most of the words.
    """
    bags = stable_copy(bags)
    both = F.col("y") + F.col("x")
    by_word = bags.groupBy("word").agg(
        F.sum(both).alias("bg"), F.count(F.lit(1)).alias("__items")
    )
    by_item = bags.groupBy("item").agg(
        F.sum("y").alias("n_y"), F.sum("x").alias("n_x"), F.count(F.lit(1)).alias("__words")
    )
    total = bags.agg(F.sum(both).alias("t")).scalar()
    frequent = bags.filter(both >= cfg.min_count)
    joined = attach_group_values(frequent, by_word, ["word"], "__items", ["item"])
    joined = attach_group_values(joined, by_item, ["item"], "__words", ["word"])
    a, a0 = F.col("a"), F.col("a0")
    y, x = F.col("y"), F.col("x")
    floor = F.lit(1e-9)
    delta = F.ln((y + a) / F.greatest(floor, F.col("n_y") + a0 - y - a)) - F.ln(
        (x + a) / F.greatest(floor, F.col("n_x") + a0 - x - a)
    )
    return (
        joined.withColumn("a0", F.lit(cfg.prior) * F.greatest(F.lit(1), total))
        .withColumn("a", F.lit(cfg.prior) * F.col("bg"))
        .select(
            "item", "word", "y", "x",
            (delta / F.sqrt(1 / (y + a) + 1 / (x + a))).alias("z"),
        )
    )


def top_keywords(scored: DataFrame, cfg: C.KeywordConfig = C.KeywordConfig()) -> DataFrame:
    """Best and worst words per item, as rows. Short lists may overlap. ``scored`` is read
    twice; store it if it is not a table."""
    best = top_per_group(scored, ["item"], [F.desc("z"), F.asc("word")], cfg.top)
    worst = top_per_group(scored, ["item"], [F.asc("z"), F.desc("word")], cfg.top)
    return best.withColumn("polarity", F.lit("pos")).unionByName(
        worst.withColumn("polarity", F.lit("neg"))
    )


def keyword_lists(top: DataFrame, cfg: C.KeywordConfig = C.KeywordConfig()) -> DataFrame:
    """One row per item: the leading words of both lists."""

    def words(polarity: str) -> Column:
        entry = F.when(F.col("polarity") == polarity, F.struct("rank", "word"))
        ordered = F.array_sort(F.collect_list(entry))
        return F.slice(F.transform(ordered, lambda e: e["word"]), 1, cfg.shown)

    return top.groupBy("item").agg(
        words("pos").alias("keywords_pos"), words("neg").alias("keywords_neg")
    )
