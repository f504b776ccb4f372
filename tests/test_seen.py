from pyspark.sql import functions as F

from plaudit.streaming import seen as S

SCHEMA = "row_id long, item string, user_id long, comment string"


def rows(spark, *given):
    return spark.createDataFrame([(i, "m", u, c) for i, u, c in given], SCHEMA)


def kept(spark, path):
    return sorted(r["row_id"] for r in S.kept_rows(spark, path).collect())


def add(spark, path, number, *given):
    S.append_unseen(rows(spark, *given), number, path, ["item", "user_id"])


def test_repeats_go_in_any_later_batch(spark, tmp_path):
    path = str(tmp_path)
    add(spark, path, 0, (5, 1, "a"), (4, 1, "a"), (6, 1, "b"), (7, None, "a"), (8, 1, None), (9, None, ""))
    assert kept(spark, path) == [4, 6, 7, 8, 9]
    add(spark, path, 1, (1, 1, "a"), (10, 2, "a"), (11, None, "a"), (12, 1, None), (13, 1, ""), (14, None, ""))
    assert kept(spark, path) == [4, 6, 7, 8, 9, 10, 13]  # an older batch counts, not a smaller id
    for number in range(2, 5):
        add(spark, path, number, (20 + number, 1, "b"), (30, 3, "late"))
    assert kept(spark, path) == [4, 6, 7, 8, 9, 10, 13, 30]


def test_a_batch_that_runs_again_gives_the_same(spark, tmp_path):
    path = str(tmp_path)
    add(spark, path, 0, (1, 1, "a"))
    add(spark, path, 1, (2, 1, "a"), (3, 1, "c"))
    before = kept(spark, path)
    add(spark, path, 1, (2, 1, "a"), (3, 1, "c"))
    assert kept(spark, path) == before == [1, 3]
    # It failed between its rows and its digests.
    rows(spark, (4, 1, "d")).withColumn("digest", F.lit(b"x")).write.parquet(f"{path}/rows/batch=2")
    add(spark, path, 2, (4, 1, "d"), (5, 1, "d"))
    assert kept(spark, path) == [1, 3, 4]


def test_empty_batches(spark, tmp_path):
    path = str(tmp_path)
    add(spark, path, 0)
    add(spark, path, 1, (1, 1, "a"))
    add(spark, path, 2)
    assert kept(spark, path) == [1]


def test_values_do_not_run_together(spark):
    given = spark.createDataFrame([("a", "1:b"), ("a1:", "b"), (None, "-"), ("-", None), ("", "")], "item string, comment string")
    assert given.select(S._digest(["item"], "comment")).distinct().count() == 5


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    batches = [[(1, 1, "a"), (2, 1, "b")], [(3, 1, "a"), (4, 2, "a")], [(5, 1, "b"), (6, 1, "c"), (7, 2, "a")]]
    for given in batches:
        rows(spark, *given).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        S.unseen_stream(stream, path, f"{tmp_path}/checkpoint", ["item", "user_id"]).awaitTermination()
    assert kept(spark, path) == [1, 2, 4, 6]
