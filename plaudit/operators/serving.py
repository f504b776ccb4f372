"""Reads behind an item page or a ranking. Inputs are the results of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.operators.scale import top_per_group


def _names(col: str) -> Column:
    return F.when(F.length(F.coalesce(F.col(col), F.lit(""))) > 0, F.split(col, "、")).otherwise(
        F.array().cast("array<string>")
    )


def list_items(summary: DataFrame, spam_summary: DataFrame | None = None) -> DataFrame:
    """Items by final score with split aspect names and, if given, the suspect rate."""
    out = summary.select(
        "item", "n_reviews", "star_pos", "star_neg", "star_mid", "model_pos", "model_neg",
        "model_pos_rate", "bayes_rating", "final_score",
        _names("pros").alias("pros"), _names("cons").alias("cons"),
    )
    if spam_summary is None:
        out = out.withColumn("suspect_rate", F.lit(None).cast("double"))
    else:
        out = out.join(spam_summary.select("item", "suspect_rate"), "item", "left")
    return out.orderBy(F.desc("final_score"), "item")


def leaderboard(summary: DataFrame, n: int = 10) -> DataFrame:
    return summary.select("item", "final_score").orderBy(F.desc("final_score"), "item").limit(n)


def item_details(summary: DataFrame, pros_cons: DataFrame | None = None,
                 spam: DataFrame | None = None) -> DataFrame:
    """Stats and scores as structs, joined with aspects, keywords and spam; one row per item."""
    out = summary.select(
        "item",
        F.struct(
            "n_reviews", "star_pos", "star_neg", "star_mid", "star_pos_rate", "model_pos",
            "model_neg", "model_pos_rate", "star_mean", "pred_rating_mean", "likes_sum",
        ).alias("stats"),
        F.struct(
            "bayes_rating", "rating_score", "sentiment_score", "final_score", "confidence"
        ).alias("score"),
    )
    if pros_cons is not None:
        out = out.join(pros_cons.drop("n_sampled"), "item", "left")
    if spam is not None:
        packed = spam.select("item", F.struct(*[c for c in spam.columns if c != "item"]).alias("spam"))
        out = out.join(packed, "item", "left")
    return out


def item_detail(details: DataFrame, item: str) -> DataFrame:
    """Details of one item; no row if the item is unknown."""
    return details.filter(F.col("item") == item)


def item_aspects(aspect_table: DataFrame, item: str) -> DataFrame:
    return aspect_table.filter(F.col("item") == item).select(
        "aspect", "mentions", "pos_rate", "like_weighted_pos_rate"
    ).orderBy(F.desc("mentions"), "aspect")


def item_spam(spam_summary: DataFrame, item: str) -> DataFrame:
    return spam_summary.filter(F.col("item") == item)


def _polarity_order(polarity: str) -> tuple[int, Column]:
    if polarity not in ("pos", "neg"):
        raise ValueError("polarity must be 'pos' or 'neg'")
    return (1, F.desc("p_pos")) if polarity == "pos" else (0, F.asc("p_pos"))


def sample_reviews(scored: DataFrame, reviews: DataFrame, item: str, polarity: str = "pos",
                   limit: int = 20) -> DataFrame:
    """Most confident reviews of one item: the best four times ``limit`` by score, joined with
    their text, the first ``limit`` of those that have one."""
    sent, by_p = _polarity_order(polarity)
    best = (
        scored.filter((F.col("item") == item) & (F.col("pred_sent") == sent))
        .select("row_id", "p_pos", "exp_rating")
        .orderBy(by_p, "row_id")
        .limit(limit * 4)
    )
    text = reviews.filter(F.col("item") == item).select("row_id", "comment", "star", "likes")
    return text.join(F.broadcast(best), "row_id").orderBy(by_p, "row_id").limit(limit).select(
        "row_id", "comment", "star", "likes", "p_pos", F.col("exp_rating").alias("pred_rating")
    )


def sample_reviews_all(scored: DataFrame, polarity: str = "pos", limit: int = 20) -> DataFrame:
    """The same choice for every item at once (ids and scores; text joins on row_id)."""
    sent, by_p = _polarity_order(polarity)
    chosen = scored.filter(F.col("pred_sent") == sent).select(
        "row_id", "item", "star", "likes", "p_pos", F.col("exp_rating").alias("pred_rating")
    )
    return top_per_group(chosen, ["item"], [by_p, F.asc("row_id")], limit)


def _shares(summary: DataFrame, names: dict[str, str], kind: str) -> DataFrame:
    long = summary.select("item", *[F.col(c).alias(n) for n, c in names.items()]).unpivot(
        ["item"], list(names), kind, "n"
    )
    total = sum((F.col(c) for c in list(names.values())[1:]), F.col(list(names.values())[0]))
    sizes = summary.select(F.col("item").alias("__item"), total.alias("__total"))
    return long.join(sizes, F.col("item") == F.col("__item")).select(
        "item", kind, "n", F.try_divide(F.col("n"), F.col("__total")).alias("share")
    )


def star_distribution(summary: DataFrame) -> DataFrame:
    return _shares(summary, {"good": "star_pos", "neutral": "star_mid", "bad": "star_neg"}, "kind")


def verdict_distribution(summary: DataFrame) -> DataFrame:
    return _shares(summary, {"good": "model_pos", "bad": "model_neg"}, "kind")
