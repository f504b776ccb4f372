import datetime as dt

from pyspark.sql import functions as F

from plaudit.streaming import jobs

DAY = dt.datetime(2024, 3, 1)


def at(days=0, **more):
    return DAY + dt.timedelta(days=days, **more)


def batches(spark, folder, frames):
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(folder)


def test_a_burst_over_midnight_is_one(spark):
    times = [at(hours=23, minutes=50), at(1), at(1, minutes=10), at(1, minutes=40), at(1, minutes=70, seconds=1), at(1, hours=9), None]
    rows = spark.createDataFrame([("u", "m", t) for t in times] + [("v", "m", at(hours=23, minutes=55))], "user_id string, item string, ts timestamp")
    runs = jobs.burst_sessions(rows, ["user_id", "item"], "30 minutes", 3).collect()
    # 0:40 is exactly the gap after 0:10 and belongs to the run, a second more begins another.
    assert [(r.user_id, r.n, r.first, r.last) for r in runs] == [("u", 4, times[0], times[3])]


def test_runs_merged_early_are_the_same(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("user_id"), F.lit("m").alias("item"),
                                    F.timestamp_seconds(F.col("id") * F.col("id") % 900_000).alias("ts")).repartition(6)
    want = sorted(map(tuple, jobs.burst_sessions(rows, ["user_id", "item"], "10 minutes", 2).collect()))
    names = ("spark.sql.sessionWindow.merge.sessions.in.local.partition", "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition")
    try:
        jobs.merge_runs_early(spark)
        got = sorted(map(tuple, jobs.burst_sessions(rows, ["user_id", "item"], "10 minutes", 2).collect()))
    finally:
        for name in names:
            spark.conf.unset(name)
    assert got == want and want


def test_late_predictions_come_as_null(spark, tmp_path):
    reviews = spark.createDataFrame([(1, 5, at()), (2, 1, at()), (3, 5, at(hours=1)), (4, 3, at(hours=1)), (9, 5, at(9))], "row_id bigint, star int, ts timestamp")
    scores = [(1, 0.01, at(hours=2)), (2, 0.02, at(hours=2)), (3, 0.03, at(2)), (4, None, at(hours=2)), (7, 0.5, at()), (9, 0.5, at(9))]
    predictions = spark.createDataFrame(scores, "row_id bigint, p_pos double, scored_ts timestamp")
    truth = {1: True, 2: False, 3: None, 4: None}
    table = jobs.late_predictions(reviews, predictions, "24 hours")
    assert {r.row_id: r.rating_mismatch for r in table.collect()} == truth | {9: False}
    left, right = str(tmp_path / "reviews"), str(tmp_path / "predictions")
    batches(spark, left, [reviews]), batches(spark, right, [predictions])
    stream = jobs.late_predictions(spark.readStream.schema(reviews.schema).parquet(left), spark.readStream.schema(predictions.schema).parquet(right), "24 hours", "1 day")
    out = str(tmp_path / "out")
    jobs.write_stream(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
    got = {r.row_id: r.rating_mismatch for r in spark.read.schema(stream.schema).parquet(out).collect()}
    assert got == truth | {9: False}
