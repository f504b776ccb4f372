"""The whole batch job: raw reviews to ranked item summary, one Parquet table per stage.

Tables between stages cut the lineage and give the later joins exact sizes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions.scoring import lexicon_p_pos, star_label, verdict
from plaudit.operators import aspects as A
from plaudit.operators import checks as Q
from plaudit.operators import evaluation as E
from plaudit.operators import keywords as K
from plaudit.operators import models as M
from plaudit.operators import ratings as R
from plaudit.operators import spam as S
from plaudit.operators import vocab as B
from plaudit.operators.cleaning import clean_reviews, dedup_keep_first, item_dimension, map_item_ids
from plaudit.operators.sampling import random_subset, sample_reviews_per_item, with_split
from plaudit.operators.scale import stable_copy
from plaudit.sources import sinks


@dataclass(frozen=True)
class BatchConfig:
    clean: C.CleanConfig = C.CleanConfig()
    sentiment: C.SentimentLexicon = C.SentimentLexicon()
    aspects: C.AspectConfig = field(default_factory=C.AspectConfig)
    keywords: C.KeywordConfig = field(default_factory=C.KeywordConfig)
    ratings: C.RatingConfig = C.RatingConfig()
    spam: C.SpamConfig = field(default_factory=C.SpamConfig)
    split: C.SplitConfig = C.SplitConfig()
    sequences: C.SequenceConfig = C.SequenceConfig()
    max_val_rows: int | None = None
    vocab_rows: int | None = None
    smoke: bool = False


def validation_metrics(predictions: DataFrame, split: C.SplitConfig, max_rows: int | None = None) -> DataFrame:
    """Calibration record and rating error on the validation rows, or on ``max_rows`` of them."""
    rows = predictions.select(
        "row_id", "star", "pred_rating", F.col("p_pos").alias("p"),
        star_label(F.col("star")).alias("label"),
    )
    chosen = with_split(rows, split).filter(F.col("split") == "val")
    val = stable_copy(chosen if max_rows is None else random_subset(chosen, max_rows))
    error = E.rating_error(val).select(F.struct("rating_acc", "rating_mae").alias("e")).scalar()
    return E.calibrate(val).withColumn("__e", error).select("*", "__e.*").drop("__e")


def trained_scorer(raw: DataFrame, path: str, cfg: BatchConfig = BatchConfig(), **fit) -> Callable[[DataFrame], DataFrame]:
    """Fit on the training rows, calibrate on the validation rows, save under ``path``, and
    return the scorer of the model as it is read back: the ``score`` of ``run``."""
    rows = stable_copy(with_split(dedup_keep_first(clean_reviews(raw, cfg.clean)), cfg.split))
    model = M.fit_review_model(rows.filter(F.col("split") == "train"), **fit)
    M.save_review_model(M.calibrated(model, rows.filter(F.col("split") == "val")), path)
    loaded = M.load_review_model(raw.sparkSession, path)
    return lambda df: M.score_reviews(loaded, df)


def prepare_sequences(reviews: DataFrame, out: str, cfg: BatchConfig = BatchConfig()) -> dict[str, DataFrame]:
    """Vocabulary and encoded reviews: supervised train and validation rows, prompts for all.
    Characters are counted over all texts, or over a spread sample of ``vocab_rows``."""
    spark = reviews.sparkSession
    counted = reviews if cfg.vocab_rows is None else random_subset(reviews, cfg.vocab_rows)
    sinks.write_table(B.build_vocab(counted, cfg.sequences), f"{out}/vocab")
    vocab = spark.read.parquet(f"{out}/vocab")
    labelled = with_split(reviews, cfg.split).filter(F.col("split") != "rest")
    supervised = B.encode_supervised(labelled, vocab, cfg.sequences)
    sinks.write_table(supervised.select("row_id", "star", "split", "ids", "labels"), f"{out}/supervised", ["split"])
    prompts = B.encode_prompts(reviews, vocab, cfg.sequences)
    sinks.write_table(prompts.select("row_id", "ids"), f"{out}/prompts")
    return {n: spark.read.parquet(f"{out}/{n}") for n in ("vocab", "supervised", "prompts")}


def run(raw: DataFrame, out: str, cfg: BatchConfig = BatchConfig(),
        score: Callable[[DataFrame], DataFrame] | None = None,
        score_clause=None) -> dict[str, DataFrame]:
    """Run all stages under the folder ``out`` and return the tables.

    ``score`` adds the score columns to reviews and ``score_clause`` maps a clause column to
    P(good); both default to the word-list scorer.
    """
    spark = raw.sparkSession
    tables: dict[str, DataFrame] = {}

    def save(name: str, df: DataFrame) -> DataFrame:
        sinks.write_table(df, f"{out}/{name}")
        tables[name] = spark.read.parquet(f"{out}/{name}")
        return tables[name]

    score = score or (lambda df: M.attach_lexicon_scores(df, cfg.sentiment))
    score_clause = score_clause or (lambda c: lexicon_p_pos(c, cfg.sentiment))

    # Text and scores share one wide table, so each text is scored once and no join by row id
    # brings them together again; narrow reads of it are pruned to their columns. The verdict is
    # taken at the threshold that the validation rows give, and stored with the narrow table.
    stored_scores = save("reviews", score(dedup_keep_first(clean_reviews(raw, cfg.clean))))
    metrics = save("metrics", validation_metrics(stored_scores, cfg.split, cfg.max_val_rows))
    threshold = float(metrics.first()["threshold"])
    reviews = tables["reviews"] = stored_scores.withColumn("pred_sent", verdict(F.col("p_pos"), threshold))
    named = raw if "item_label" in raw.columns else raw.withColumn("item_label", F.col("item"))
    items = save("items", item_dimension(named))
    predictions = save("predictions", map_item_ids(reviews.drop("comment"), items))
    sampled = reviews.select("row_id", "item", "likes", "pred_sent", "comment")
    if cfg.aspects.sample_per_item is not None:
        sampled = save("sampled", sample_reviews_per_item(sampled, cfg.aspects.sample_per_item, cfg.aspects.seed))
    mentions = save("mentions", A.aspect_mentions(sampled, score_clause, cfg.aspects))
    table = save("aspects", A.aspect_table(mentions, cfg.aspects))
    odds = stable_copy(K.log_odds(K.word_bags(sampled, cfg.keywords), cfg.keywords))
    keywords = save("keywords", K.top_keywords(odds, cfg.keywords))
    pros_cons = save(
        "pros_cons",
        A.pros_and_cons(table, sampled, K.keyword_lists(keywords, cfg.keywords), cfg.aspects),
    )
    base = save("spam_base", S.signal_base(reviews, cfg.spam))
    detail = save("spam_detail", S.spam_detail(base, cfg.spam))
    per_item = save("spam_summary", S.spam_summary(detail))
    suspects = save("suspects", S.rank_suspects(detail, cfg.spam))
    save("top_suspects", S.suspect_texts(suspects, reviews, cfg.spam))
    scores = R.item_scores(R.item_stats(predictions), cfg.ratings)
    summary = save("summary", R.item_summary(scores, pros_cons, per_item))
    report = save("report", sinks.report_blocks(summary, pros_cons))
    sinks.write_csv(summary, f"{out}/files/summary_csv")
    sinks.write_json(summary, f"{out}/files/summary_json")
    sinks.write_json(metrics, f"{out}/files/metrics_json")
    sinks.write_json(pros_cons, f"{out}/files/pros_cons_json")
    sinks.write_report(report, f"{out}/files/report", sinks.report_header(summary))
    save(
        "checks",
        Q.all_checks(
            Q.summary_checks(summary, smoke=cfg.smoke),
            Q.prediction_checks(predictions, threshold, dense=False),
            Q.spam_checks(per_item, detail, cfg.smoke),
            Q.aspect_checks(pros_cons, cfg.smoke),
            Q.totals_check(summary, per_item),
        ).orderBy(F.col("check")),
    )
    return tables
