"""Ten signals of suspicious reviews, scores, reasons and summaries.

``signal_base`` reads the text once and leaves narrow rows; store its result (``stable_copy``),
as everything after it reads it more than once. Group sizes are counted with partial
aggregation and joined back size-aware.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions.scoring import star_label
from plaudit.functions.text import is_advert, normalize_text, template_head, text_digest
from plaudit.operators.scale import (
    BROADCAST_ROWS,
    attach_group_values,
    compute_once,
    stable_copy,
    stored,
    top_per_group,
)


def day_number(date: Column) -> Column:
    """Days since 1970-01-01, -1 for an unreadable date."""
    return F.coalesce(F.unix_date(F.try_to_date(date)), F.lit(-1))


def signal_base(reviews: DataFrame, cfg: C.SpamConfig = C.SpamConfig()) -> DataFrame:
    """Narrow row per review: keys, the row-local flags and digests in place of the text.

    Needs row_id, item, user_id, day_no, star, likes, comment and p_pos (NULL if not scored).
    """
    text = F.col("comment")
    wide = compute_once(reviews, "norm", normalize_text(text))
    label = star_label(F.col("star"))
    p = F.col("p_pos")
    mismatch = ((p >= cfg.confident_positive) & (label == 0)) | (
        (p <= cfg.confident_negative) & (label == 1)
    )
    return wide.select(
        "row_id", "item", "user_id", "day_no", "star", "likes",
        F.length("norm").alias("norm_len"),
        text_digest(F.col("norm")).alias("norm_key"),
        template_head(F.col("norm"), cfg.template_chars).alias("template_key"),
        is_advert(text, cfg.ad_pattern).alias("ad"),
        F.coalesce(mismatch, F.lit(False)).alias("rating_mismatch"),
        ((F.col("likes") >= cfg.bomb_likes) & (F.length(text) <= cfg.bomb_chars)).alias("like_bomb"),
        (F.length("norm") <= cfg.low_info_chars).alias("low_info"),
    )


def text_groups(base: DataFrame) -> DataFrame:
    """Per item and normalised text: copies in the item, items and copies overall, and rows of
    the item with the same opening."""
    same = stable_copy(
        base.groupBy("item", "norm_key", "template_key").agg(
            F.count(F.lit(1)).alias("dup_same_movie_size")
        )
    )
    across = same.groupBy("norm_key").agg(
        F.count(F.lit(1)).alias("text_movie_count"),
        F.sum("dup_same_movie_size").alias("text_total_count"),
    )
    openings = (
        same.filter(F.col("template_key").isNotNull())
        .groupBy("item", "template_key")
        .agg(F.sum("dup_same_movie_size").alias("template_size"), F.count(F.lit(1)).alias("__texts"))
        .filter(F.col("__texts") > 1)
    )
    alone = F.when(F.col("template_key").isNotNull(), F.col("dup_same_movie_size")).otherwise(0)
    out = attach_group_values(
        same, across.filter(F.col("text_movie_count") > 1), ["norm_key"], "text_movie_count", ["item"]
    )
    out = attach_group_values(out, openings, ["item", "template_key"], "__texts", ["norm_key"])
    return out.select(
        "item", "norm_key", "dup_same_movie_size",
        F.coalesce("text_movie_count", F.lit(1)).alias("text_movie_count"),
        F.coalesce("text_total_count", "dup_same_movie_size").alias("text_total_count"),
        F.coalesce("template_size", alone).alias("template_size"),
    )


def item_days(base: DataFrame) -> DataFrame:
    return base.groupBy("item", "day_no").agg(F.count(F.lit(1)).alias("movie_day_count"))


def day_cut(base: DataFrame, cfg: C.SpamConfig = C.SpamConfig()) -> DataFrame:
    """One row with the exact quantile of the item-day volume.

    ``day_over='rows'`` weighs each item-day by its reviews, ``'days'`` counts it once. The
    quantile reads (volume, frequency) pairs; there are at most sqrt(2 * reviews) volumes.
    """
    weight = F.col("movie_day_count") if cfg.day_over == "rows" else F.lit(1)
    volumes = item_days(base).groupBy("movie_day_count").agg(F.sum(weight).alias("freq"))
    return volumes.agg(
        F.percentile("movie_day_count", F.lit(cfg.day_quantile), F.col("freq")).alias("day_burst_p999")
    )


def user_days(base: DataFrame) -> DataFrame:
    """Per user, item and day: the size of that group and of (user, item)."""
    daily = base.groupBy("user_id", "item", "day_no").agg(
        F.count(F.lit(1)).alias("user_movie_day_count")
    )
    # A (user, item) window holds one row per day, however many reviews there are.
    per_item = F.sum("user_movie_day_count").over(W.partitionBy("user_id", "item"))
    return daily.withColumn("user_movie_count", per_item)


def user_groups(base: DataFrame) -> DataFrame:
    """Per user, item and day: the size of that group, of (user, item) and of (item, day)."""
    daily = stable_copy(user_days(base))
    volume = daily.groupBy("item", "day_no").agg(
        F.sum("user_movie_day_count").alias("movie_day_count"), F.count(F.lit(1)).alias("__users")
    )
    return attach_group_values(daily, volume, ["item", "day_no"], "__users", ["user_id"]).drop("__users")


def user_features(base: DataFrame) -> DataFrame:
    """Behaviour of each review's user, with the user's total over all items."""
    groups = stable_copy(user_groups(base))
    totals = groups.groupBy("user_id").agg(
        F.sum("user_movie_day_count").alias("user_total"), F.count(F.lit(1)).alias("__days")
    )
    groups = attach_group_values(groups, totals, ["user_id"], "__days", ["item", "day_no"])
    rows = base.select("row_id", "user_id", "item", "day_no")
    return attach_group_values(
        rows, groups.drop("__days"), ["user_id", "item", "day_no"], "user_movie_day_count", ["row_id"]
    ).select(
        "row_id", "user_id", F.col("day_no").alias("day"), "user_total", "user_movie_count",
        "user_movie_day_count", "movie_day_count",
    )


def with_text_groups(base: DataFrame) -> DataFrame:
    """Adds the text group sizes; groups where every size is trivial do not travel."""
    groups = text_groups(base).filter(
        (F.col("dup_same_movie_size") > 1) | (F.col("text_movie_count") > 1) | (F.col("template_size") > 1)
    )
    out = attach_group_values(
        base, groups, ["item", "norm_key"], "dup_same_movie_size", ["row_id"]
    )
    one = F.lit(1)
    no_template = F.when(F.col("template_key").isNull(), 0).otherwise(1)
    return out.withColumns(
        {
            "dup_same_movie_size": F.coalesce("dup_same_movie_size", one),
            "text_movie_count": F.coalesce("text_movie_count", one),
            "text_total_count": F.coalesce("text_total_count", one),
            "template_size": F.coalesce("template_size", no_template),
        }
    )


def with_user_groups(base: DataFrame) -> DataFrame:
    """Adds the user group sizes and the volume of the item's day. Only users with several reviews
    of an item travel; the volumes, one row per item and day, are few."""
    daily = stable_copy(user_days(base))
    volume = daily.groupBy("item", "day_no").agg(F.sum("user_movie_day_count").alias("movie_day_count"))
    several = daily.filter(F.col("user_movie_count") > 1)
    out = attach_group_values(
        base, several, ["user_id", "item", "day_no"], "user_movie_day_count", ["row_id"]
    )
    out = attach_group_values(out, volume, ["item", "day_no"], "movie_day_count", ["row_id"])
    sizes = ("user_movie_day_count", "user_movie_count")
    return out.withColumns({c: F.coalesce(c, F.lit(1).cast("bigint")) for c in sizes})


def spam_detail(base: DataFrame, cfg: C.SpamConfig = C.SpamConfig()) -> DataFrame:
    """One row per review with all signals, score, verdict, reasons and group sizes."""
    sized = with_user_groups(with_text_groups(base))
    cut = day_cut(base, cfg).scalar()
    real = F.col("norm_len") > 0 if cfg.ignore_empty else F.lit(True)
    flagged = sized.withColumn("day_burst_p999", cut).withColumns(
        {
            "dup_same_movie": real & (F.col("dup_same_movie_size") >= cfg.dup_same_min),
            "dup_cross_movie": real & (F.col("text_movie_count") >= cfg.dup_cross_items),
            "template": F.col("template_size") >= cfg.template_min,
            "user_burst": F.col("user_movie_day_count") >= cfg.burst_min,
            "user_repeat": F.col("user_movie_count") >= cfg.repeat_min,
            "movie_day_burst": F.col("movie_day_count") > F.col("day_burst_p999"),
        }
    )
    return score_signals(flagged, cfg).select(
        "row_id", "item", "star", "likes", *C.SIGNALS,
        "spam_points", "spam_score", "is_suspect", "reasons",
        "dup_same_movie_size", "text_total_count", "text_movie_count", "template_size",
        "user_movie_count", "user_movie_day_count", "movie_day_count", "day_burst_p999",
    )


def score_signals(flagged: DataFrame, cfg: C.SpamConfig = C.SpamConfig()) -> DataFrame:
    """Weighted score of boolean signal columns, in whole hundredths up to the comparison."""
    points = F.lit(0)
    for name, weight in cfg.weights.items():
        points = points + F.when(F.col(name), weight).otherwise(0)
    names = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in cfg.weights]))
    total = F.least(F.lit(100), points)
    return flagged.withColumn("spam_points", total).withColumns(
        {
            "spam_score": F.col("spam_points") / 100,
            "is_suspect": F.col("spam_points") >= cfg.suspect_at,
            "reasons": names,
        }
    )


def reasons_text(reasons: Column) -> Column:
    return F.concat_ws("|", reasons)


def spam_summary(detail: DataFrame) -> DataFrame:
    """Per item: reviews, suspects, rate, mean score and hits per signal."""
    return detail.groupBy("item").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count_if("is_suspect").alias("n_suspect"),
        F.avg(F.col("is_suspect").cast("int")).alias("suspect_rate"),
        (F.sum("spam_points") / F.count(F.lit(1)) / 100).alias("mean_spam_score"),
        F.max("day_burst_p999").alias("day_burst_p999"),
        *[F.count_if(s).alias(f"spam_{s}") for s in C.SIGNALS],
    )


def by_type(summary: DataFrame) -> DataFrame:
    """The hit counts as one map column."""
    pairs = []
    for s in C.SIGNALS:
        pairs += [F.lit(s), F.col(f"spam_{s}")]
    return summary.withColumn("by_type", F.create_map(*pairs)).drop(*[f"spam_{s}" for s in C.SIGNALS])


def rank_suspects(detail: DataFrame, cfg: C.SpamConfig = C.SpamConfig()) -> DataFrame:
    """Most suspicious reviews per item, without text."""
    suspects = detail.filter("is_suspect").select(
        "row_id", "item", "star", "likes", "spam_points", "spam_score", "reasons"
    )
    order = [F.desc("spam_points"), F.desc("likes"), F.asc("row_id")]
    return top_per_group(suspects, ["item"], order, cfg.top_suspects).drop("spam_points")


def suspect_texts(suspects: DataFrame, reviews: DataFrame, cfg: C.SpamConfig = C.SpamConfig()) -> DataFrame:
    """Adds the opening of the text. There are a few suspects per item; stored and counted, they
    are broadcast to the reviews unless the items are very many."""
    few, rows = stored(suspects)
    text = reviews.select("row_id", F.substring("comment", 1, cfg.shown_chars).alias("comment"))
    return text.join(F.broadcast(few) if rows <= BROADCAST_ROWS else few, "row_id", "inner").select(
        *suspects.columns, "comment"
    )


def nested_spam_summary(summary: DataFrame, top: DataFrame) -> DataFrame:
    """The summary with hit map and suspects nested, one row per item."""
    entry = F.struct("rank", "comment", "star", "likes", "spam_score", reasons_text(F.col("reasons")).alias("reasons"))
    packed = top.groupBy("item").agg(F.array_sort(F.collect_list(entry)).alias("top_suspects"))
    bare = F.transform("top_suspects", lambda e: e.dropFields("rank"))
    return by_type(summary).join(packed.withColumn("top_suspects", bare), "item", "left")


def signal_ranking(summary: DataFrame, k: int = 3) -> DataFrame:
    """Strongest signals per item."""
    long = summary.unpivot(
        ["item"], [f"spam_{s}" for s in C.SIGNALS], "signal", "hits"
    ).withColumn("signal", F.substring("signal", len("spam_") + 1, 100))
    return top_per_group(long, ["item"], [F.desc("hits"), F.asc("signal")], k)


def site_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.sum("n_suspect").alias("n_suspect"),
        F.sum("n_reviews").alias("n_reviews"),
        (F.sum("n_suspect") / F.sum("n_reviews")).alias("suspect_rate"),
    )


def most_suspect_items(summary: DataFrame, n: int = 8) -> DataFrame:
    return summary.select("item", "n_reviews", "n_suspect", "suspect_rate").orderBy(
        F.desc("suspect_rate"), "item"
    ).limit(n)
