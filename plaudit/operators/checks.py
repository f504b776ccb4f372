"""Data-quality checks as a table (check, level, violations, ok)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED, WARNING = "required", "warning"


def _checks(df: DataFrame, tests: dict[str, tuple[str, Column]]) -> DataFrame:
    """All tests of a table in one aggregation; a test is an aggregate that counts violations."""
    one = df.agg(*[agg.cast("bigint").alias(name) for name, (_, agg) in tests.items()])
    levels = F.create_map(*[F.lit(x) for name, (lvl, _) in tests.items() for x in (name, lvl)])
    long = one.unpivot([], list(tests), "check", "violations")
    return long.select(
        "check", levels[F.col("check")].alias("level"), "violations",
        (F.col("violations") == 0).alias("ok"),
    )


def _outside(name: str, low, high) -> Column:
    """Rows outside the range; a missing value counts as outside."""
    return F.count_if(~F.coalesce(F.col(name).between(low, high), F.lit(False)))


def _strict(smoke: bool) -> str:
    """Level of the checks that small trial inputs need not pass."""
    return WARNING if smoke else REQUIRED


def summary_checks(summary: DataFrame, min_reviews: int = 1000, smoke: bool = False) -> DataFrame:
    n = F.col("n_reviews")
    tests = {
        "final_score_range": (REQUIRED, _outside("final_score", 0, 10)),
        "bayes_rating_range": (REQUIRED, _outside("bayes_rating", 1, 5)),
        "confidence_range": (REQUIRED, _outside("confidence", 0, 1)),
        "stars_add_up": (REQUIRED, F.count_if(F.col("star_pos") + F.col("star_neg") + F.col("star_mid") != n)),
        "verdicts_add_up": (REQUIRED, F.count_if(F.col("model_pos") + F.col("model_neg") != n)),
        "enough_reviews": (_strict(smoke), F.count_if(n < min_reviews)),
    }
    return _checks(summary, tests)


def prediction_checks(scored: DataFrame, threshold: float = 0.5, dense: bool = True) -> DataFrame:
    """Ranges of the scores; uniqueness, and if asked density, of the row ids."""
    rows, ids = F.count(F.lit(1)), F.count_distinct("row_id")
    agree = (F.col("p_pos") >= threshold).cast("int") == F.col("pred_sent")
    tests = {
        "p_pos_range": (REQUIRED, _outside("p_pos", 0, 1)),
        "pred_sent_values": (REQUIRED, F.count_if(~F.coalesce(F.col("pred_sent").isin(0, 1), F.lit(False)))),
        "exp_rating_range": (WARNING, _outside("exp_rating", 1, 5)),
        "verdict_follows_threshold": (WARNING, F.count_if(~F.coalesce(agree, F.lit(False)))),
        "row_id_unique": (REQUIRED, rows - ids),
    }
    if dense:
        span = F.max("row_id") - F.min("row_id") + 1
        tests["row_id_dense"] = (REQUIRED, F.abs(span - ids) + F.abs(F.min("row_id")))
    return _checks(scored, tests)


def spam_checks(spam_summary: DataFrame, detail: DataFrame, smoke: bool = False) -> DataFrame:
    per_item = {
        "suspect_rate_range": (REQUIRED, _outside("suspect_rate", 0, 1)),
        "suspects_within_reviews": (REQUIRED, F.count_if(F.col("n_suspect") > F.col("n_reviews"))),
        "every_item_has_suspects": (_strict(smoke), F.count_if(F.col("n_suspect") == 0)),
    }
    per_row = {
        "suspects_have_reasons": (REQUIRED, F.count_if(F.col("is_suspect") & (F.size("reasons") == 0))),
        "spam_score_range": (REQUIRED, _outside("spam_score", 0, 1)),
    }
    return _checks(spam_summary, per_item).unionByName(_checks(detail, per_row))


def aspect_checks(pros_cons: DataFrame, smoke: bool = False) -> DataFrame:
    """Every item has pros, and cons or weak points; evidence is never an empty string."""
    listed = F.concat("pros", "cons", "weak")
    blank = F.exists(listed, lambda e: F.exists(e["evidence"], lambda s: F.coalesce(s, F.lit("")) == ""))
    tests = {
        "has_pros": (_strict(smoke), F.count_if(F.size("pros") == 0)),
        "has_cons_or_weak": (_strict(smoke), F.count_if((F.size("cons") == 0) & (F.size("weak") == 0))),
        "evidence_not_blank": (REQUIRED, F.count_if(blank)),
    }
    return _checks(pros_cons, tests)


def totals_check(left: DataFrame, right: DataFrame, name: str = "totals_match") -> DataFrame:
    """Review counts of two per-item tables, compared item by item."""
    pair = left.select("item", F.col("n_reviews").alias("a")).join(
        right.select("item", F.col("n_reviews").alias("b")), "item", "full"
    )
    return _checks(pair, {name: (REQUIRED, F.count_if(~F.col("a").eqNullSafe(F.col("b"))))})


def metric_gates(metrics: DataFrame) -> DataFrame:
    """Quality gates on a row of metrics."""
    tests = {
        "accuracy": (REQUIRED, F.count_if(~(F.col("acc") > 0.80))),
        "f1_good": (REQUIRED, F.count_if(~(F.col("f1_pos") > 0.85))),
        "rating_mae": (REQUIRED, F.count_if(~(F.col("rating_mae") < 0.8))),
        "threshold": (REQUIRED, F.count_if(~((F.col("threshold") > 0.05) & (F.col("threshold") < 0.95)))),
    }
    return _checks(metrics, tests)


def all_checks(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def passed(checks: DataFrame) -> DataFrame:
    """One row: failed required checks and failed warnings."""
    return checks.agg(
        F.count_if((F.col("level") == REQUIRED) & ~F.col("ok")).alias("failures"),
        F.count_if((F.col("level") == WARNING) & ~F.col("ok")).alias("warnings"),
    )
