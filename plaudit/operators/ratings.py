"""Item statistics, Bayesian scores and the item summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions.scoring import star_label


def item_stats(scored: DataFrame, labels: C.LabelConfig = C.LabelConfig()) -> DataFrame:
    """Everything countable about an item in one aggregation.

    ``scored`` has item, star, likes, p_pos, pred_sent and exp_rating.
    """
    star, sent = F.col("star"), F.col("pred_sent")
    label = star_label(star, labels)
    return scored.groupBy("item").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count_if(label == 1).alias("star_pos"),
        F.count_if(label == 0).alias("star_neg"),
        F.count_if(star == labels.neutral).alias("star_mid"),
        F.count_if(sent == 1).alias("model_pos"),
        F.count_if(sent == 0).alias("model_neg"),
        F.avg(sent).alias("model_pos_rate"),
        F.avg("p_pos").alias("p_pos_mean"),
        F.avg("exp_rating").alias("pred_rating_mean"),
        F.avg(star).alias("star_mean"),
        F.sum(star).alias("star_sum"),
        F.sum("likes").alias("likes_sum"),
        F.avg("likes").alias("likes_mean"),
    ).withColumn("star_pos_rate", F.col("star_pos") / F.col("n_reviews"))


def prior_mean(stats: DataFrame) -> Column:
    """Mean star over all rows, from the item sums."""
    return stats.agg((F.sum("star_sum") / F.sum("n_reviews")).alias("m")).scalar()


def item_scores(stats: DataFrame, cfg: C.RatingConfig = C.RatingConfig(),
                prior: Column | None = None) -> DataFrame:
    """Adds the Bayesian mean, the three 0-10 scores and the confidence, unrounded."""
    n, m = F.col("n_reviews"), F.lit(cfg.prior_weight)
    mean = prior_mean(stats) if prior is None else prior
    return (
        stats.withColumn("prior_mean", mean)
        .withColumn("bayes_rating", (F.col("star_sum") + m * F.col("prior_mean")) / (n + m))
        .withColumn("rating_score", (F.col("bayes_rating") - 1) / 4 * 10)
        .withColumn("sentiment_score", F.col("model_pos_rate") * 10)
        .withColumn(
            "final_score",
            cfg.star_share * F.col("rating_score") + cfg.model_share * F.col("sentiment_score"),
        )
        .withColumn("confidence", n / (n + m))
        .drop("prior_mean")
    )


def rounded_scores(summary: DataFrame) -> DataFrame:
    """Presentation form: final score to 2 digits, confidence to 3."""
    return summary.withColumn("final_score", F.bround("final_score", 2)).withColumn(
        "confidence", F.bround("confidence", 3)
    )


SUMMARY_COLUMNS = [
    "item", "n_reviews", "star_pos", "star_neg", "star_mid", "star_pos_rate", "model_pos",
    "model_neg", "model_pos_rate", "pred_rating_mean", "star_mean", "bayes_rating",
    "rating_score", "sentiment_score", "final_score", "confidence", "likes_sum", "likes_mean",
]


def aspect_names(entries: Column) -> Column:
    return F.concat_ws("、", F.transform(entries, lambda e: e["aspect"]))


def item_summary(scores: DataFrame, pros_cons: DataFrame | None = None,
                 spam_summary: DataFrame | None = None) -> DataFrame:
    """Ranked summary. Aspects and spam counts are optional sides; all inputs have one row per
    item."""
    out = scores.select(*SUMMARY_COLUMNS)
    if pros_cons is not None:
        names = pros_cons.select(
            "item", aspect_names(F.col("pros")).alias("pros"), aspect_names(F.col("cons")).alias("cons")
        )
        out = out.join(names, "item", "left").fillna("", ["pros", "cons"])
    if spam_summary is not None:
        counts = spam_summary.select("item", "n_suspect", "suspect_rate")
        out = out.join(counts, "item", "left").fillna(0, ["n_suspect", "suspect_rate"])
    return out.orderBy(F.desc("final_score"), "item")
