"""Item aggregates as partial states per segment of rows, replaced and merged.

A segment is a range of row ids, as the prediction shards have it. Its states are what can be added
up or ranked again: counts and sums per item, sums per item and aspect, the best quotes, word counts,
hits per signal and the worst suspects. When rows of a segment change, its states alone are computed
and replaced; whatever is read is merged from the states, whose number does not depend on the
number of reviews, so a page or a ranking never reads the corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions.scoring import like_weight, star_label
from plaudit.functions.text import word_tokens
from plaudit.operators import aspects as A
from plaudit.operators import keywords as K
from plaudit.operators import ratings as R
from plaudit.operators import spam as X
from plaudit.operators.scale import stable_copy, top_per_group
from plaudit.sources.sinks import segment

AVERAGED = ("pred_sent", "p_pos", "exp_rating", "star", "likes")
KINDS = ("items", "aspects", "evidence", "words", "spam", "suspects")


@dataclass(frozen=True)
class StateConfig:
    """``rows_per_segment`` is how many row ids share a state. A state has as many rows as its
    segment has items (and aspects, words), so segments should hold many reviews per item."""

    rows_per_segment: int = 250_000
    labels: C.LabelConfig = field(default_factory=C.LabelConfig)
    aspects: C.AspectConfig = field(default_factory=C.AspectConfig)
    keywords: C.KeywordConfig = field(default_factory=C.KeywordConfig)
    spam: C.SpamConfig = field(default_factory=C.SpamConfig)


def with_segment(rows: DataFrame, cfg: StateConfig) -> DataFrame:
    return rows.withColumn("segment", segment(F.col("row_id"), cfg.rows_per_segment))


def item_states(scored: DataFrame, cfg: StateConfig = StateConfig()) -> DataFrame:
    """Counts per segment and item, and sum and count of everything that is averaged."""
    label = star_label(F.col("star"), cfg.labels)
    sums = [f(c).alias(f"{c}_{name}") for c in AVERAGED for name, f in (("sum", F.sum), ("count", F.count))]
    return with_segment(scored, cfg).groupBy("segment", "item").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(label == 1).alias("star_pos"), F.count_if(label == 0).alias("star_neg"),
        F.count_if(F.col("star") == cfg.labels.neutral).alias("star_mid"),
        F.count_if(F.col("pred_sent") == 1).alias("model_pos"), F.count_if(F.col("pred_sent") == 0).alias("model_neg"),
        *sums,
    )


def aspect_states(mentions: DataFrame, cfg: StateConfig = StateConfig()) -> DataFrame:
    w = like_weight(F.col("likes"))
    return with_segment(mentions, cfg).groupBy("segment", "item", "aspect").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("p_sum"), F.count("p").alias("p_count"),
        F.sum(w * F.col("p")).alias("wp_sum"), F.sum(w).alias("w_sum"),
    )


def evidence_states(mentions: DataFrame, cfg: StateConfig = StateConfig()) -> DataFrame:
    """The best quotes of every segment; the best of all are among them."""
    polarity = F.when(F.col("p") >= 0.5, "pos").otherwise("neg")
    strength = 2 * F.abs(F.col("p") - 0.5) * like_weight(F.col("likes"))
    rows = with_segment(mentions, cfg).withColumn("polarity", polarity).withColumn("strength", strength)
    columns = ["segment", "item", "aspect", "polarity", "clause", "p", "likes", "strength", "row_id"]
    return _best(rows.select(*columns), ["segment", "item", "aspect", "polarity"], _BY_STRENGTH, cfg.aspects.evidence)


_BY_STRENGTH = ("-strength", "clause", "row_id")
_BY_POINTS = ("-spam_points", "-likes", "row_id")


def _best(rows: DataFrame, keys: list[str], order: tuple[str, ...], k: int) -> DataFrame:
    by = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order]
    return top_per_group(rows, keys, by, k).withColumn("n", F.lit(1).cast("bigint"))


def word_states(scored: DataFrame, cfg: StateConfig = StateConfig(), tokenize: Callable[[Column], Column] | None = None) -> DataFrame:
    """Word counts per segment and item. All segments must share a tokenizer: n-grams, or a segmenter
    over a stored dictionary. One mined from the rows of a segment would differ from the others."""
    tokenize = tokenize or word_tokens
    keyed = with_segment(scored, cfg).withColumn("item", F.struct("segment", "item"))
    bags = K.word_bags(keyed, cfg.keywords, tokenize)
    return bags.select("item.segment", "item.item", "word", "y", "x", F.lit(1).cast("bigint").alias("n"))


def spam_states(detail: DataFrame, cfg: StateConfig = StateConfig()) -> DataFrame:
    return with_segment(detail, cfg).groupBy("segment", "item").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_suspect").alias("n_suspect"), F.sum("spam_points").alias("points"),
        F.max("day_burst_p999").alias("day_burst_p999"), *[F.count_if(s).alias(f"spam_{s}") for s in C.SIGNALS],
    )


def suspect_states(detail: DataFrame, cfg: StateConfig = StateConfig()) -> DataFrame:
    columns = ["segment", "item", "row_id", "star", "likes", "spam_points", "spam_score", "reasons"]
    rows = with_segment(detail.filter("is_suspect"), cfg).select(*columns)
    return _best(rows, ["segment", "item"], _BY_POINTS, cfg.spam.top_suspects)


def write_states(states: DataFrame, path: str, cfg: StateConfig = StateConfig(), start: int | None = None, end: int | None = None) -> None:
    """Write the states of all rows, or of the row ids [start, end), which replace those of the
    segments in that range; a segment that has no rows any more gets an empty state. The bounds lie
    on segment borders."""
    size = cfg.rows_per_segment
    if start is None and end is None:
        _by_segment(states).write.mode("overwrite").partitionBy("segment").parquet(path)
        return
    if start is None or end is None or start % size or end % size:
        raise ValueError("a range must start and end on a segment border")
    first, last = start // size, end // size
    mine = states.filter(F.col("segment").between(first, last - 1))
    marks = states.sparkSession.range(first, last).select(F.col("id").alias("segment"), F.lit(0).cast("bigint").alias("n"))
    both = mine.unionByName(marks, allowMissingColumns=True)
    _by_segment(both).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(path)


def _by_segment(states: DataFrame) -> DataFrame:
    """Each segment in one task, so that it becomes one file, and not one for every task that has
    rows of it. A state is bounded by the size of its segment."""
    parts = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return states.repartition(parts, "segment")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("n > 0")


def merged_items(states: DataFrame) -> DataFrame:
    """What ``item_stats`` gives for all rows."""
    counts = ("star_pos", "star_neg", "star_mid", "model_pos", "model_neg")
    mean = lambda c: (F.sum(f"{c}_sum") / F.sum(f"{c}_count"))
    return states.groupBy("item").agg(
        F.sum("n").alias("n_reviews"), *[F.sum(c).alias(c) for c in counts],
        mean("pred_sent").alias("model_pos_rate"), mean("p_pos").alias("p_pos_mean"), mean("exp_rating").alias("pred_rating_mean"),
        mean("star").alias("star_mean"), F.sum("star_sum").alias("star_sum"), F.sum("likes_sum").alias("likes_sum"),
        mean("likes").alias("likes_mean"),
    ).withColumn("star_pos_rate", F.col("star_pos") / F.col("n_reviews"))


def merged_aspects(states: DataFrame) -> DataFrame:
    """What ``aspect_rates`` gives for all mentions."""
    return states.groupBy("item", "aspect").agg(
        F.sum("n").alias("mentions"), (F.sum("p_sum") / F.sum("p_count")).alias("pos_rate"),
        (F.sum("wp_sum") / F.sum("w_sum")).alias("like_weighted_pos_rate"),
    )


def merged_evidence(states: DataFrame, cfg: StateConfig = StateConfig()) -> DataFrame:
    """What ``aspect_evidence`` gives for all mentions."""
    return _best(states.drop("rank", "segment"), ["item", "aspect", "polarity"], _BY_STRENGTH, cfg.aspects.evidence).drop("n")


def merged_words(states: DataFrame) -> DataFrame:
    """What ``word_bags`` gives for all reviews."""
    return states.groupBy("item", "word").agg(F.sum("y").alias("y"), F.sum("x").alias("x"))


def merged_spam(states: DataFrame) -> DataFrame:
    """What ``spam_summary`` gives for all rows."""
    n = F.sum("n")
    return states.groupBy("item").agg(
        n.alias("n_reviews"), F.sum("n_suspect").alias("n_suspect"), (F.sum("n_suspect") / n).alias("suspect_rate"),
        (F.sum("points") / n / 100).alias("mean_spam_score"), F.max("day_burst_p999").alias("day_burst_p999"),
        *[F.sum(f"spam_{s}").alias(f"spam_{s}") for s in C.SIGNALS],
    )


def merged_suspects(states: DataFrame, cfg: StateConfig = StateConfig()) -> DataFrame:
    """What ``rank_suspects`` gives for all rows."""
    return _best(states.drop("rank", "segment"), ["item"], _BY_POINTS, cfg.spam.top_suspects).drop("n", "spam_points")


def write_all(scored: DataFrame, mentions: DataFrame, detail: DataFrame, path: str, cfg: StateConfig = StateConfig(),
              start: int | None = None, end: int | None = None) -> None:
    """All kinds of states, each in its folder below ``path``. The inputs may hold the range alone."""
    made = {
        "items": item_states(scored, cfg), "aspects": aspect_states(mentions, cfg), "evidence": evidence_states(mentions, cfg),
        "words": word_states(scored, cfg), "spam": spam_states(detail, cfg), "suspects": suspect_states(detail, cfg),
    }
    for kind in KINDS:
        write_states(made[kind], f"{path}/{kind}", cfg, start, end)


def item_page(spark: SparkSession, path: str, item: str | None = None, cfg: StateConfig = StateConfig()) -> DataFrame:
    """One row per item, or of one: counts, scores, pros, cons, weak points with quotes, keywords,
    hits per signal and the worst suspects, all from the states.

    The prior of the scores and of the keywords is that of all items, so their states are merged
    before the item is taken; everything else is read for the item alone.
    """
    states = {kind: read_states(spark, f"{path}/{kind}") for kind in KINDS}
    one = {k: v if item is None or k in ("items", "words") else v.filter(F.col("item") == item) for k, v in states.items()}
    page = R.item_scores(merged_items(states["items"]))
    rates, quotes = merged_aspects(one["aspects"]), merged_evidence(one["evidence"], cfg)
    entry = F.struct("rank", "clause", "p", "likes")

    def pick(polarity: str) -> Column:
        chosen = F.array_sort(F.collect_list(F.when(F.col("polarity") == polarity, entry)))
        return F.transform(chosen, lambda e: F.struct(e["clause"], e["p"].alias("p_pos"), e["likes"]))

    lists = quotes.groupBy("item", "aspect").agg(pick("pos").alias("evidence_pos"), pick("neg").alias("evidence_neg"))
    table = rates.join(lists, ["item", "aspect"], "left")
    odds = K.log_odds(merged_words(states["words"]), cfg.keywords).withColumn("z", F.round("z", 3))
    words = K.keyword_lists(K.top_keywords(stable_copy(odds), cfg.keywords), cfg.keywords)
    sizes = page.select("item", F.col("n_reviews").alias("n_sampled"))
    aspects = A.pros_and_cons_of(stable_copy(table), sizes, words, cfg.aspects).drop("n_sampled")
    spam = X.by_type(merged_spam(one["spam"])).drop("n_reviews")
    suspects = merged_suspects(one["suspects"], cfg).groupBy("item").agg(
        F.array_sort(F.collect_list(F.struct("rank", "row_id", "star", "likes", "spam_score", "reasons"))).alias("top_suspects")
    )
    out = page.join(aspects, "item", "left").join(spam, "item", "left").join(suspects, "item", "left")
    return out if item is None else out.filter(F.col("item") == item)
