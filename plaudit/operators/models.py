"""Trained scoring with Spark ML, and the hook for any other scorer.

A scored table has row_id -> p_pos, pred_sent, exp_rating, pred_rating, p_rating.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions import scoring as S
from plaudit.operators.scale import stable_copy


def attach_lexicon_scores(reviews: DataFrame, lexicon: C.SentimentLexicon = C.SentimentLexicon(),
                          threshold=0.5, text: str = "comment") -> DataFrame:
    """Word-list scorer: deterministic, row-local, no training."""
    scored = reviews.withColumn("p_pos", S.lexicon_p_pos(F.col(text), lexicon))
    return _rating_columns(
        scored.withColumns(
            {
                "pred_sent": S.verdict(F.col("p_pos"), threshold),
                "__dist": S.binomial_ratings(F.col("p_pos")),
            }
        )
    )


def _rating_columns(with_dist: DataFrame) -> DataFrame:
    dist = F.col("__dist")
    return with_dist.withColumns(
        {
            "exp_rating": S.expected_rating(dist),
            "pred_rating": S.best_rating(dist),
            "p_rating": S.best_rating_p(dist),
        }
    ).drop("__dist")


@dataclass(frozen=True)
class ReviewModel:
    """Features, a sentiment model and a rating model that also sees the verdict."""

    features: PipelineModel
    sentiment: PipelineModel
    rating: PipelineModel
    threshold: float = 0.5


def save_review_model(model: ReviewModel, path: str) -> None:
    """Write the three parts and the threshold under a folder."""
    for name in ("features", "sentiment", "rating"):
        getattr(model, name).write().overwrite().save(f"{path}/{name}")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(model.threshold,)], "threshold double").write.mode("overwrite").parquet(f"{path}/threshold")


def load_review_model(spark: SparkSession, path: str) -> ReviewModel:
    parts = {name: PipelineModel.load(f"{path}/{name}") for name in ("features", "sentiment", "rating")}
    return ReviewModel(**parts, threshold=spark.read.parquet(f"{path}/threshold").first()["threshold"])


def calibrated(model: ReviewModel, val: DataFrame) -> ReviewModel:
    """The model with the threshold that is best on labelled validation rows."""
    from plaudit.operators.evaluation import best_threshold

    rows = score_reviews(model, val).select(S.star_label(F.col("star")).alias("label"), F.col("p_pos").alias("p"))
    return replace(model, threshold=float(best_threshold(rows).first()["threshold"]))


def _verdict_stage(scored: DataFrame, threshold: float) -> DataFrame:
    p = vector_to_array("sent_probability")[1]
    return scored.withColumn("p_pos", p).withColumn("pred_sent", S.verdict(F.col("p_pos"), threshold))


def fit_review_model(train: DataFrame, features: int = 1 << 16, max_iter: int = 20,
                     reg: float = 0.01, threshold: float = 0.5, text: str = "comment",
                     token_pattern: str = r"[一-龥]|\p{L}+") -> ReviewModel:
    """Fit on stars. Neutral reviews train the rating only.

    The rating model gets the true sentiment as a feature while training (0.5 for neutral
    rows) and the verdict while scoring. The term counts are stored, as every fit reads them more
    than once: the texts are cleaned and cut once.
    """
    words = RegexTokenizer(inputCol=text, outputCol="tokens", pattern=token_pattern, gaps=False)
    counts = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features)
    counted = stable_copy(counts.transform(words.transform(train)).select("star", "tf"))
    idf = IDF(inputCol="tf", outputCol="tfidf").fit(counted)
    fitted = PipelineModel([words, counts, idf])
    label = S.star_label(F.col("star"))
    rows = idf.transform(counted).withColumn("sent_label", label)
    sentiment = Pipeline(
        stages=[
            LogisticRegression(
                featuresCol="tfidf", labelCol="sent_label", predictionCol="sent_prediction",
                probabilityCol="sent_probability", rawPredictionCol="sent_raw",
                maxIter=max_iter, regParam=reg,
            )
        ]
    ).fit(rows.filter(F.col("sent_label") >= 0))
    hint = F.when(F.col("sent_label") < 0, 0.5).otherwise(F.col("sent_label").cast("double"))
    rating = _rating_stages(max_iter, reg).fit(
        rows.withColumn("verdict_feature", hint).withColumn("rating_label", F.col("star").cast("double"))
    )
    return ReviewModel(fitted, sentiment, rating, threshold)


def _rating_stages(max_iter: int, reg: float) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=["tfidf", "verdict_feature"], outputCol="rating_features"),
            LogisticRegression(
                featuresCol="rating_features", labelCol="rating_label",
                predictionCol="rating_prediction", probabilityCol="rating_probability",
                rawPredictionCol="rating_raw", family="multinomial", maxIter=max_iter, regParam=reg,
            ),
        ]
    )


def score_reviews(model: ReviewModel, reviews: DataFrame) -> DataFrame:
    """Adds the score columns; no shuffle."""
    scored = _verdict_stage(model.sentiment.transform(model.features.transform(reviews)), model.threshold)
    rated = model.rating.transform(scored.withColumn("verdict_feature", F.col("pred_sent").cast("double")))
    # Class 0 never occurs: ratings are their own class labels 1..5.
    dist = F.slice(vector_to_array("rating_probability"), 2, 5)
    return _rating_columns(rated.withColumn("__dist", dist)).select(
        *reviews.columns, "p_pos", "pred_sent", "exp_rating", "pred_rating", "p_rating"
    )


def score_distinct_texts(rows: DataFrame, text: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score every distinct text once and join the scores back. Worth it for a costly scorer
    on short texts that repeat, such as clauses. The rows are stored, as they are read twice."""
    from plaudit.functions.text import text_digest
    from plaudit.operators.scale import attach_group_values

    keyed = stable_copy(rows.withColumn("__key", text_digest(F.col(text))))
    distinct = keyed.groupBy("__key", text).agg(F.count(F.lit(1)).alias("__rows"))
    scored = score(distinct).drop(text)
    spread = [c for c in rows.columns if c != text]
    return attach_group_values(keyed, scored, ["__key"], "__rows", spread or [text]).drop("__key", "__rows")


BatchScorer = Callable[[pd.Series], pd.DataFrame]


def score_in_batches(reviews: DataFrame, load: Callable[[], BatchScorer], keep: list[str],
                     text: str = "comment") -> DataFrame:
    """Plug in any Python model. ``load`` runs once per task and returns a function from a batch
    of texts to a frame with p_pos, pred_sent, exp_rating, pred_rating and p_rating."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in reviews.select(*keep).schema]
    schema = ", ".join(
        [*fields, "p_pos double", "pred_sent int", "exp_rating double", "pred_rating int", "p_rating double"]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            scores = scorer(batch[text]).reset_index(drop=True)
            yield pd.concat([batch[keep].reset_index(drop=True), scores], axis=1)

    return reviews.select(*dict.fromkeys([*keep, text])).mapInPandas(run, schema)


def predict_text(spark, text: str, score: Callable[[DataFrame], DataFrame], threshold: float = 0.5) -> DataFrame:
    """One-row answer for a single text; an empty text is refused."""
    if not text.strip():
        raise ValueError("text is empty")
    row = spark.range(1).select(F.col("id").alias("row_id"), F.lit(text.strip()).alias("comment"))
    return prediction_record(score(row), threshold)


def prediction_record(scored: DataFrame, threshold: float | Column = 0.5) -> DataFrame:
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return scored.select(
        F.col("comment").alias("text"),
        F.when(F.col("p_pos") >= thr, "positive").otherwise("negative").alias("sentiment"),
        "p_pos", thr.alias("threshold"), F.col("exp_rating").alias("pred_rating"),
        F.col("pred_rating").alias("rating_argmax"), F.col("p_rating").alias("confidence"),
    )
