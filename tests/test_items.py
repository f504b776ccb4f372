import pytest
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.operators import checks as Q
from plaudit.operators import models as M
from plaudit.operators import ratings as R
from plaudit.operators import serving as V

ROWS = [
    (i, "m1" if i % 3 else "m2", i % 5 + 1, i * 7 % 50, "喜欢，精彩" if i % 4 else "垃圾，无聊", i % 2) for i in range(60)
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(ROWS, "row_id bigint, item string, star int, likes int, comment string, flag int")
    return M.attach_lexicon_scores(df).cache()


@pytest.fixture(scope="module")
def summary(scored):
    return R.item_summary(R.item_scores(R.item_stats(scored))).cache()


def test_scores(scored, summary):
    rows = {r["item"]: r for r in summary.collect()}
    prior = sum(r[2] for r in ROWS) / len(ROWS)
    for item, r in rows.items():
        stars = [x[2] for x in ROWS if x[1] == item]
        bayes = (sum(stars) + 100 * prior) / (len(stars) + 100)
        good = sum(1 for x in ROWS if x[1] == item and x[0] % 4) / len(stars)
        assert r.bayes_rating == pytest.approx(bayes)
        assert r.final_score == pytest.approx(0.6 * (bayes - 1) / 4 * 10 + 0.4 * 10 * good)
        assert r.confidence == pytest.approx(len(stars) / (len(stars) + 100))
        assert r.star_pos + r.star_neg + r.star_mid == r.n_reviews == r.model_pos + r.model_neg
    assert [r.final_score for r in summary.collect()] == sorted((r.final_score for r in rows.values()), reverse=True)
    assert R.rounded_scores(summary).first().final_score == round(summary.first().final_score, 2)


def test_summary_sides_are_optional(spark, scored):
    scores = R.item_scores(R.item_stats(scored))
    spam = spark.createDataFrame([("m1", 4, 0.1)], "item string, n_suspect bigint, suspect_rate double")
    out = {r["item"]: r for r in R.item_summary(scores, None, spam).collect()}
    assert (out["m1"].n_suspect, out["m2"].n_suspect, out["m2"].suspect_rate) == (4, 0, 0.0)


def test_reads(spark, scored, summary):
    assert V.leaderboard(summary, 1).count() == 1
    sample = V.sample_reviews(scored, scored, "m1", "neg", 3).collect()
    assert len(sample) == 3 and all(r.p_pos < 0.5 for r in sample)
    assert V.sample_reviews(scored, scored, "unknown").count() == 0
    with pytest.raises(ValueError):
        V.sample_reviews(scored, scored, "m1", "meh")
    everything = V.sample_reviews_all(scored, "pos", 5)
    assert everything.groupBy("item").count().agg(F.max("count")).first()[0] == 5
    for r in V.star_distribution(summary).groupBy("item").agg(F.sum("share").alias("s")).collect():
        assert r.s == pytest.approx(1)
    named = summary.withColumns({"pros": F.lit("a、b"), "cons": F.lit("")})
    row = V.list_items(named).first()
    assert row.pros == ["a", "b"] and row.cons == [] and row.suspect_rate is None
    assert V.item_detail(V.item_details(summary), "m1").first().stats.n_reviews == 40


def test_checks_find_violations(spark, scored, summary):
    good = Q.all_checks(Q.summary_checks(summary, 1), Q.prediction_checks(scored))
    assert Q.passed(good).first().failures == 0
    broken = scored.withColumn("p_pos", F.when(F.col("row_id") == 3, 1.5).when(F.col("row_id") == 4, None).otherwise(F.col("p_pos")))
    broken = broken.unionByName(broken.filter("row_id = 5"))
    found = {r.check: r.violations for r in Q.prediction_checks(broken).collect()}
    assert found["p_pos_range"] == 2 and found["row_id_unique"] == 1 and found["row_id_dense"] == 0
    assert Q.totals_check(summary, summary.filter("item = 'm1'")).first().violations == 1
    metrics = spark.createDataFrame([(0.9, 0.8, 0.5, 0.5)], "acc double, f1_pos double, rating_mae double, threshold double")
    assert {r.check for r in Q.metric_gates(metrics).filter("not ok").collect()} == {"f1_good"}


def test_single_text(spark):
    r = M.predict_text(spark, " 喜欢，精彩 ", M.attach_lexicon_scores).first()
    assert (r.text, r.sentiment, r.p_pos) == ("喜欢，精彩", "positive", 0.75)
    with pytest.raises(ValueError):
        M.predict_text(spark, "  ", M.attach_lexicon_scores)


def test_trained_model_points_the_right_way(spark):
    rows = [(i, "good film love" if i % 2 else "bad film hate", (5 if i % 4 == 1 else 4) if i % 2 else (1 if i % 4 else 2)) for i in range(80)]
    rows += [(100 + i, "film", 3) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id bigint, comment string, star int")
    model = M.fit_review_model(df, features=1 << 8, max_iter=15)
    out = M.score_reviews(model, df).collect()
    for r in out:
        assert 0 <= r.p_pos <= 1 and 1 <= r.exp_rating <= 5 and r.pred_rating in range(1, 6)
        if r.star != 3:
            assert r.pred_sent == int(r.star >= 4) and (r.pred_rating >= 4) == (r.star >= 4)


def test_distinct_texts_are_scored_once(spark, join_mode):
    df = spark.createDataFrame([(i, f"t{i % 3}") for i in range(30)], "row_id bigint, clause string")
    out = M.score_distinct_texts(df, "clause", lambda d: d.withColumn("p", F.length("clause") / 10))
    assert out.count() == 30 and set(out.columns) == {"row_id", "clause", "p"}
    assert {r.p for r in out.collect()} == {0.2}
