import pytest
from pyspark.sql import functions as F

from plaudit.operators import cube, sketches
from plaudit.operators.scale import stable_copy
from plaudit.operators.states import StateConfig, read_states, write_states
from plaudit.sources import driver_tables as D
from conftest import SF

SCHEMA = "row_id bigint, item string, user_id bigint, day_no int, comment string"


def reviews(spark, n=4000):
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.concat(F.lit("m"), F.col("id") % 7).alias("item"), (F.col("id") % 611).alias("user_id"),
        (F.col("id") % 30).cast("int").alias("day_no"), F.repeat(F.lit("ab"), ((F.col("id") * 37) % 503).cast("int")).alias("comment"))


def test_merged_states_are_within_their_bounds(spark):
    cfg = sketches.SketchConfig(log_registers=12, k=200, rows_per_segment=500)
    rows = stable_copy(reviews(spark))
    states = sketches.profile_states(rows, cfg)
    assert states.count() == 8
    audit = sketches.errors_within(stable_copy(sketches.merged_profile(states)), rows, cfg).first()
    assert (audit.n_rows, audit.exact_users, audit.exact_texts, audit.len_max) == (4000, 611, 503, 1004)
    assert all(v for k, v in audit.asDict().items() if k.endswith("_ok"))
    # The same segments in another order and from other tasks give the same distinct counts.
    again = sketches.merged_profile(sketches.profile_states(rows.repartition(5), cfg)).first()
    first = sketches.merged_profile(states).first()
    assert [again[f"n_{n}"] for n in sketches.DISTINCT] == [first[f"n_{n}"] for n in sketches.DISTINCT]


def test_a_replaced_segment_counts_once(spark, tmp_path):
    cfg = sketches.SketchConfig(rows_per_segment=1000)
    size, path = StateConfig(rows_per_segment=1000), str(tmp_path / "states")
    rows = stable_copy(reviews(spark))
    write_states(sketches.profile_states(rows, cfg), path, size)
    other = rows.filter("row_id < 1000").withColumn("user_id", F.lit(5).cast("bigint")).withColumn("comment", F.lit("x"))
    write_states(sketches.profile_states(other, cfg), path, size, 0, 1000)
    merged = sketches.merged_profile(read_states(spark, path))
    full = other.unionByName(rows.filter("row_id >= 1000"))
    audit = sketches.errors_within(stable_copy(merged), full, cfg).first()
    assert audit.n_rows == 4000 and all(v for k, v in audit.asDict().items() if k.endswith("_ok"))
    write_states(sketches.profile_states(full.filter("row_id >= 1000"), cfg), path, size, 0, 1000)  # the segment is gone
    assert sketches.merged_profile(read_states(spark, path)).first().n_rows == 3000


def test_edges_of_the_profile(spark):
    empty = spark.createDataFrame([], SCHEMA)
    one = sketches.merged_profile(sketches.profile_states(empty)).collect()
    assert len(one) == 1 and one[0].len_p50 is None and one[0].len_max is None
    rows = spark.createDataFrame([(0, None, None, None, None), (1, "a", 1, 1, ""), (2, "a", 1, 1, "x" * 200_000), (3, "a", 1, 1, "x" * 200_000)], SCHEMA)
    got = sketches.merged_profile(sketches.profile_states(rows)).first()
    assert (got.n_rows, got.empty_comment, got.len_max, got.n_users, got.dup_global) == (4, 2, 200_000, 2, 1)


def test_levels_of_the_cube(spark):
    data = [("a", 5, 1, 2, 0.5), ("a", 5, 0, 1, 0.25), ("b", 1, 0, 4, 0.125), (None, 3, None, 1, 0.5)]
    rows = spark.createDataFrame(data, "item string, star int, pred_sent int, likes int, p_pos double")
    got = cube.review_cube(rows)
    total = cube.level_of(got, ()).collect()
    assert [(r.n, r.likes_sum, r.p_pos_sum) for r in total] == [(4, 8, 1.375)]
    assert {(r.item, r.n) for r in cube.level_of(got, ("item",)).collect()} == {("a", 2), ("b", 1), (None, 1)}
    assert {(r.item, r.pred_sent, r.share) for r in cube.shares(got, "pred_sent").collect()} == {("a", 1, 0.5), ("a", 0, 0.5), ("b", 0, 1.0), (None, None, 1.0)}
    assert cube.review_cube(rows.limit(0)).filter("grouping_id <> 7").count() == 0
    with pytest.raises(ValueError):
        cube.review_cube(rows, [("day",)])


def test_the_cube_reads_the_reviews_once(spark):
    rows = D.reviews(spark, SF).withColumn("pred_sent", F.lit(1)).withColumn("p_pos", F.lit(0.5))
    plan = cube.review_cube(rows)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    expand = next(i for i, line in enumerate(lines) if "Expand" in line)
    assert plan.count("Expand") == 1 and any("Aggregate" in line for line in lines[expand + 1:])  # multiplied after the first aggregate
