import datetime as dt

import pytest
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.operators import models as M
from plaudit.plans import batch
from plaudit.sources import readers, sinks
from plaudit.streaming import jobs
from test_spam import SCHEMA, make_rows


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        "ID,Movie_Name_EN,Movie_Name_CN,Crawl_Date,Number,Username,Date,Star,Comment,Like\n"
        '0,Zoo,动物城,2017-01-22,1,甲,2016-03-05,5,"很好看, ""真的""\n第二行",12\n'
        "1,Zoo,动物城,2017-01-22,2,乙,bad,1,NA,\n", encoding="utf-8")
    rows = readers.as_reviews(readers.read_raw_csv(spark, str(path))).orderBy("row_id").collect()
    assert rows[0].comment == '很好看, "真的"\n第二行' and rows[0].day_no == 16865 and rows[0]["item"] == "动物城"
    assert (rows[1].day_no, rows[1].likes, rows[1].comment) == (-1, 0, "NA")
    from plaudit.operators.cleaning import clean_reviews
    kept = clean_reviews(readers.as_reviews(readers.read_raw_csv(spark, str(path)))).collect()
    assert [r.comment for r in kept] == ['很好看, "真的" 第二行']


def test_segments_can_be_written_again(spark, tmp_path):
    path = str(tmp_path / "preds")
    df = spark.range(100).select(
        F.col("id").alias("row_id"), F.lit("m").alias("item"), F.lit(5).alias("star"), F.lit(0).alias("likes"),
        F.lit(0.5).alias("p_pos"), F.lit(1).alias("pred_sent"), F.lit(3.0).alias("exp_rating"), F.lit(3).alias("pred_rating"), F.lit(0.4).alias("p_rating"))
    sinks.write_segments(df, path, 25, start=0, end=50)
    sinks.write_segments(df, path, 25, start=25, end=100)
    sinks.write_segments(df.withColumn("p_pos", F.lit(0.9)), path, 25, start=50, end=75)
    back = readers.read_predictions(spark, path, ["row_id", "p_pos"])
    assert back.count() == back.select("row_id").distinct().count() == 100
    assert {r.row_id for r in back.filter("p_pos > 0.8").collect()} == set(range(50, 75))
    with pytest.raises(ValueError):
        sinks.write_segments(df, path, 25, start=10)
    assert readers.read_optional(spark, path + "-none") is None


def test_whole_batch(spark, tmp_path):
    raw = spark.createDataFrame(make_rows(400), SCHEMA).drop("p_pos")
    cfg = batch.BatchConfig(split=C.SplitConfig(val_below=300, train_below=700), aspects=C.AspectConfig(min_mentions=3), keywords=C.KeywordConfig(min_count=2), smoke=True)
    tables = batch.run(raw, str(tmp_path), cfg)
    n = tables["reviews"].count()
    assert tables["summary"].agg(F.sum("n_reviews")).first()[0] == n == tables["spam_detail"].count()
    items = {r["item"]: r.item_id for r in tables["items"].collect()}
    assert sorted(items.values()) == list(range(len(items)))
    assert all(items[r["item"]] == r.item_id for r in tables["predictions"].select("item", "item_id").distinct().collect())
    failed = [r.check for r in tables["checks"].filter("level = 'required' and not ok").collect()]
    assert failed == []
    block = tables["report"].orderBy(F.desc("final_score")).first().block
    assert block.startswith("score: m") and "suspicious: " in block
    files = str(tmp_path / "files")
    text = spark.read.text(f"{files}/report", wholetext=True).collect()
    assert any("reviews: %d" % n in r.value for r in text)
    metrics = tables["metrics"].first()
    assert spark.read.json(f"{files}/metrics_json").first().threshold == metrics.threshold
    wrong = tables["predictions"].filter((F.col("p_pos") >= metrics.threshold).cast("int") != F.col("pred_sent"))
    assert wrong.count() == 0 and tables["predictions"].count() == n
    assert metrics.n > 0 and 0 <= metrics.rating_acc <= 1
    seq = batch.prepare_sequences(tables["reviews"], str(tmp_path / "seq"), cfg)
    assert seq["prompts"].count() == n
    assert {r.split for r in seq["supervised"].select("split").distinct().collect()} <= {"train", "val"}
    assert seq["supervised"].filter(F.size("ids") != F.size("labels")).count() == 0
    csv = spark.read.option("header", True).csv(f"{files}/summary_csv")
    assert csv.count() == tables["summary"].count() and "final_score" in csv.columns
    assert spark.read.json(f"{files}/pros_cons_json").count() == tables["pros_cons"].count()


def test_trained_path(spark, tmp_path):
    """Fit, calibrate, save, load and score give the scores of the model in memory."""
    raw = spark.createDataFrame(make_rows(300), SCHEMA).drop("p_pos")
    cfg = batch.BatchConfig(split=C.SplitConfig(val_below=300, train_below=1000))
    score = batch.trained_scorer(raw, str(tmp_path / "model"), cfg, features=1 << 8, max_iter=3)
    rows = raw.filter("comment is not null")
    got = score(rows).select("row_id", "p_pos", "pred_sent").collect()
    loaded = M.load_review_model(spark, str(tmp_path / "model"))
    again = M.score_reviews(loaded, rows).select("row_id", "p_pos", "pred_sent").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == rows.count()
    assert all((r.p_pos >= loaded.threshold) == (r.pred_sent == 1) for r in got)


@pytest.fixture()
def late_events(spark, tmp_path):
    day = lambda d, h=12: dt.datetime(2024, 1, d, h)
    files = [
        [(1, "u", "m", day(1), "same text"), (2, "u", "m", day(1, 13), "same  text"), (3, "v", "m", day(1), "other text")],
        [(4, "u", "m", day(2), "third"), (5, "u", "m", day(10), "later")],
        [(7, "u", "m", day(12), "end")],
        [(6, "w", "m", day(1), "too late")],
    ]
    schema = "row_id bigint, user_id string, item string, ts timestamp, comment string"
    folder = tmp_path / "in"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        import time
        time.sleep(1.1)
    return str(folder), schema


def _run(spark, df, tmp_path, name):
    out = str(tmp_path / name)
    jobs.write_stream(df, out, str(tmp_path / f"{name}-cp")).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _stream(spark, late_events):
    folder, schema = late_events
    empty = spark.createDataFrame([], schema)
    return jobs.read_stream(spark, folder, empty.schema, files_per_trigger=1)


def test_stream_dedup(spark, late_events, tmp_path):
    out = _run(spark, jobs.dedup_stream(_stream(spark, late_events), ["user_id", "item"]), tmp_path, "d")
    assert sorted(r.row_id for r in out.collect()) in ([1, 3, 4, 5, 7], [2, 3, 4, 5, 7])


def test_stream_volume_and_bursts(spark, late_events, tmp_path):
    out = _run(spark, jobs.day_volume_stream(_stream(spark, late_events)), tmp_path, "v")
    got = {r.day.day: r.n for r in out.collect()}
    assert got[1] == 3 and got[2] == 1 and 12 not in got
    bursts = _run(spark, jobs.burst_stream(_stream(spark, late_events), ["user_id", "item"], 2), tmp_path, "b")
    assert [(r.user_id, r.day.day, r.n) for r in bursts.collect()] == [("u", 1, 2)]


def test_stream_scores_match_batch(spark, late_events, tmp_path):
    folder, schema = late_events
    out, cp = str(tmp_path / "s"), str(tmp_path / "s-cp")
    jobs.score_stream(_stream(spark, late_events), M.attach_lexicon_scores, out, cp).awaitTermination()
    jobs.score_stream(_stream(spark, late_events), M.attach_lexicon_scores, out, cp).awaitTermination()
    got = spark.read.parquet(out).select("row_id", "p_pos")
    want = M.attach_lexicon_scores(spark.read.parquet(folder)).select("row_id", "p_pos")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_counts_by_updates_lose_no_tail(spark, late_events, tmp_path):
    df = jobs.day_volume_stream(_stream(spark, late_events))
    out, cp = str(tmp_path / "u"), str(tmp_path / "u-cp")
    jobs.write_updates(df, out, cp).awaitTermination()
    jobs.write_updates(df, out, cp).awaitTermination()
    got = {r.day.day: r.n for r in jobs.latest_counts(spark, out, df.schema, ["item", "day"]).collect()}
    assert got == {1: 3, 2: 1, 10: 1, 12: 1}  # the row that came after the watermark is dropped


def test_stored_tables_can_be_dropped(spark):
    from plaudit.operators.scale import drop_stored, shared_folder, stable_copy

    copy = stable_copy(spark.range(5))
    assert copy.count() == 5
    folder = shared_folder(spark).rpartition("/")[0]
    drop_stored(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


@pytest.mark.parametrize("parts", [None, 3])
def test_table_stream_reads_a_file_and_a_folder(spark, tmp_path, parts):
    """a table that is a folder of part files gave an empty stream."""
    path = str(tmp_path / "t.parquet")
    rows = spark.range(30).withColumn("text", F.lit("x"))
    if parts:
        rows.repartition(parts).write.parquet(path)
    else:
        rows.toPandas().to_parquet(path)
    jobs.write_stream(jobs.read_table_stream(spark, path), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == list(range(30))
