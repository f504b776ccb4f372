"""Evaluation and threshold calibration of scored reviews.

Inputs have ``label`` (1 good, 0 bad; other values are ignored) and ``p``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.operators.scale import running_totals, stable_copy


def _labelled(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("label").isin(0, 1) & F.col("p").isNotNull())


def _ratio(top: Column, bottom: Column) -> Column:
    return top.cast("double") / F.greatest(bottom, F.lit(1))


def _f1(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))


def confusion(scored: DataFrame, threshold=0.5) -> DataFrame:
    """One row of counts and rates at a threshold (a number or a scalar column)."""
    hit = F.col("p") >= F.col("__thr")
    good = F.col("label") == 1
    counts = (
        _labelled(scored)
        .withColumn("__thr", threshold if isinstance(threshold, Column) else F.lit(threshold))
        .agg(
            F.first("__thr").alias("threshold"),
            F.count_if(hit & good).alias("tp"),
            F.count_if(hit & ~good).alias("fp"),
            F.count_if(~hit & good).alias("fn"),
            F.count_if(hit == good).alias("correct"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        "threshold", "tp", "fp", "fn", "n",
        _ratio(F.col("correct"), F.col("n")).alias("acc"),
        precision.alias("precision_pos"),
        recall.alias("recall_pos"),
        _f1(precision, recall).alias("f1_pos"),
        _ratio(F.col("tp") + F.col("fp"), F.col("n")).alias("pos_rate_pred"),
        _ratio(F.col("tp") + F.col("fn"), F.col("n")).alias("pos_rate_true"),
    )


def rating_error(scored: DataFrame, predicted: str = "pred_rating", actual: str = "star") -> DataFrame:
    gap = F.abs(F.col(predicted) - F.col(actual))
    return scored.agg(
        F.avg((gap == 0).cast("int")).alias("rating_acc"),
        F.avg(gap).alias("rating_mae"),
        F.count(gap).alias("n"),
    )


def score_steps(scored: DataFrame) -> DataFrame:
    """Per distinct score: good and bad rows, and both counts at or above it."""
    steps = _labelled(scored).groupBy("p").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    return running_totals(stable_copy(steps), "p", ["pos", "neg"])


def best_threshold(scored: DataFrame) -> DataFrame:
    """One row: the cut with the highest F1 of the good class; the highest cut on a tie.
    With no labelled row the threshold is 0.5."""
    steps = score_steps(scored)
    totals = steps.agg(F.sum("pos")).scalar()
    precision = _ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    recall = _ratio(F.col("cum_pos"), F.col("__all"))
    f1 = steps.withColumn("__all", totals).select("p", _f1(precision, recall).alias("f1"))
    best = f1.agg(F.max(F.struct("f1", "p")).alias("b"))
    return best.select(
        F.coalesce(F.col("b.p"), F.lit(0.5)).alias("threshold"), F.col("b.f1").alias("f1_pos")
    )


def calibrate(scored: DataFrame) -> DataFrame:
    """Calibration record: the best threshold and the metrics measured again at it."""
    return confusion(scored, best_threshold(scored).select("threshold").scalar())


def selection_score(metrics: DataFrame) -> DataFrame:
    """Score that picks the best of several models: acc + F1 - MAE / 4."""
    return metrics.withColumn(
        "selection", F.col("acc") + F.col("f1_pos") - F.col("rating_mae") / 4
    )


def best_model(metrics: DataFrame, name: str = "model") -> DataFrame:
    return selection_score(metrics).orderBy(F.desc("selection"), name).limit(1)


def star_model_agreement(scored: DataFrame) -> DataFrame:
    """Counts by star label and model verdict."""
    return scored.groupBy("label", "pred_sent").agg(F.count(F.lit(1)).alias("n"))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve from ranks; tied scores count half."""
    steps = score_steps(scored)
    good, bad = F.sum("pos"), F.sum("neg")
    beaten = F.col("__bad") - F.col("cum_neg") + F.col("neg") / 2.0
    total_bad = steps.agg(F.sum("neg")).scalar()
    return steps.withColumn("__bad", total_bad).agg(
        F.try_divide(F.sum(F.col("pos") * beaten), (good * bad).cast("double")).alias("auc"),
        good.alias("n_pos"),
        bad.alias("n_neg"),
    )
