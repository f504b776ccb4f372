from collections import Counter

from pyspark.sql import functions as F

from plaudit.operators import scale
from plaudit.operators.cleaning import dedup_keep_first, item_dimension, map_item_ids
from plaudit.operators.sampling import random_subset, sample_reviews_per_item, sample_texts, split_counts, with_key_split


def skewed(spark, n=3000):
    """A third of the rows in one group, some keys NULL, many small groups."""
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 400).cast("string"))
        ).alias("k"),
    )


def test_attach_counts_every_row(spark, join_mode):
    df = skewed(spark)
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = {r.id: r.n for r in scale.attach_group_values(df, counts, ["k"], "n", ["id"]).collect()}
    rows = [(r.id, r.k) for r in df.collect()]
    truth = Counter(k for _, k in rows)
    assert got == {i: truth[k] for i, k in rows}


def test_attach_keep_and_missing_groups(spark, join_mode):
    df = skewed(spark)
    firsts = df.groupBy("k").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = scale.attach_group_values(df, firsts, ["k"], "n", ["id"], keep=lambda g: F.col("id") == g["first"])
    assert out.count() == df.select("k").distinct().count()


def test_hot_rows_are_spread_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(scale, "HOT_GROUPS", 1)
    df = skewed(spark)
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = scale.attach_group_values(df, counts, ["k"], "n", ["id"])
        sizes = [r["count"] for r in out.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 1000 and max(sizes) < 300


def test_sample_per_group_is_exact(spark, join_mode):
    df = skewed(spark)
    for n in (1, 7, 500):
        got = Counter(r.k for r in sample_reviews_per_item(df, n, 42, "k", "id").collect())
        truth = Counter(r.k for r in df.collect())
        assert got == {k: min(n, c) for k, c in truth.items()}
    a = {r.id for r in sample_reviews_per_item(df, 7, 1, "k", "id").collect()}
    b = {r.id for r in sample_reviews_per_item(df.repartition(5), 7, 1, "k", "id").collect()}
    assert a == b != {r.id for r in sample_reviews_per_item(df, 7, 2, "k", "id").collect()}


def test_other_samples(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"))
    picked = [r.row_id for r in sample_texts(df, 35, 10, 100).collect()]
    assert len(picked) == len(set(picked)) == 35
    per_block = Counter(i // 100 for i in picked)
    assert max(per_block.values()) <= 10 and max(per_block) >= 8  # rows from the last blocks, too
    whole = Counter(r.row_id // 100 for r in sample_texts(df, 1000, 10, 100).collect())
    assert whole == {b: 10 for b in range(10)}
    assert random_subset(df, 50).count() == random_subset(df, 50).distinct().count() == 50


def test_running_totals(spark, monkeypatch):
    monkeypatch.setattr(scale, "QUANTILE_BUCKETS", 8)
    rows = [(i / 7.0, i % 5, (i * i) % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "p double, a bigint, b bigint")
    out = scale.running_totals(df, "p", ["a", "b"]).orderBy(F.desc("p")).collect()
    a = b = 0
    for r in out:
        a, b = a + r.a, b + r.b
        assert (r.cum_a, r.cum_b) == (a, b)
    one = spark.createDataFrame([(0.5, 2, 1)], "p double, a bigint, b bigint")
    assert scale.running_totals(one, "p", ["a", "b"]).first().cum_a == 2


def test_dense_index(spark):
    names = [f"n{(i * 37) % 211:03d}" for i in range(211)]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(7)
    got = {r.name: r.id for r in scale.dense_index(df, ["name"]).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_dedup_keeps_the_first(spark, join_mode):
    rows = [(i, "m" if i % 3 == 0 else f"m{i % 4}", None if i % 5 == 0 else i % 6, f"text {i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "row_id bigint, item string, user_id int, comment string")
    seen, keep = set(), set()
    for i, item, user, text in rows:
        if (item, user, text) not in seen:
            seen.add((item, user, text))
            keep.add(i)
    assert {r.row_id for r in dedup_keep_first(df).collect()} == keep


def test_item_dimension_and_map(spark):
    df = spark.createDataFrame(
        [(2, "b", "B2"), (1, "b", "B1"), (3, "a", "A")], "row_id bigint, item string, item_label string"
    )
    dim = item_dimension(df)
    assert sorted(map(tuple, dim.collect())) == [(0, "a", "A"), (1, "b", "B1")]
    more = df.union(spark.createDataFrame([(4, "zz", "")], df.schema))
    assert {r.row_id: r.item_id for r in map_item_ids(more, dim).collect()} == {1: 1, 2: 1, 3: 0, 4: -1}


def test_compute_once_is_not_evaluated_below_the_filter(spark):
    df = scale.compute_once(spark.range(5), "v", F.concat(F.col("id").cast("string"), F.lit("x")))
    plan = df.filter(F.length("v") > 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("concat(") == 1
    assert df.columns == ["id", "v"] and df.count() == 5


def test_large_k_is_cut_in_salted_parts(spark, monkeypatch):
    monkeypatch.setattr(scale, "GROUP_LIMIT", 10)
    df = skewed(spark)
    got = scale.top_per_group(df, ["k"], [F.desc("id")], 25).groupBy("k").agg(F.sum("id").alias("s")).collect()
    by_key = {}
    for r in df.collect():
        by_key.setdefault(r.k, []).append(r.id)
    assert {r.k: r.s for r in got} == {k: sum(sorted(v)[-25:]) for k, v in by_key.items()}


def test_key_split_is_stable(spark):
    df = spark.range(2000).select((F.col("id") % 500).alias("a"), F.lit("x").alias("b"))
    split = with_key_split(df, ["a", "b"])
    assert split.groupBy("a", "b").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    sizes = {r.split: r.n for r in split_counts(split).collect()}
    assert sum(sizes.values()) == 2000 and 200 < sizes["train"] < 560


def test_few_groups_with_long_keys_are_not_broadcast(spark, monkeypatch):
    """The size of the stored groups decides, not their number alone."""
    fact = spark.range(60).select(F.col("id"), F.concat(F.lit("k" * 500), F.col("id") % 4).alias("k"))
    groups = fact.groupBy("k").agg(F.count(F.lit(1)).alias("n"))

    def run():
        found = scale.attach_group_values(fact, groups, ["k"], "n", ["id"])
        assert {(r.id, r.n) for r in found.collect()} == {(i, 15) for i in range(60)}
        return "__salt" in found._jdf.queryExecution().analyzed().toString()

    assert not run()
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 100)
    assert run()
