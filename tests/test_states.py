import pytest
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions.text import word_tokens
from plaudit.operators import aspects as A
from plaudit.operators import keywords as K
from plaudit.operators import ratings as R
from plaudit.operators import spam as X
from plaudit.operators import states as Z

CFG = Z.StateConfig(
    10, aspects=C.AspectConfig(lexicon={"plot": ("story",), "sound": ("music",)}, clause_pattern="[,.]+", min_mentions=1),
    keywords=C.KeywordConfig(min_count=1, stop_words=()), spam=C.SpamConfig(top_suspects=2),
)


def scored(spark, n=47):
    texts = ["a fine story, good music.", "bad story.", "music is loud, story is long", "nothing here"]
    rows = [
        (i, f"m{i % 3}" if i % 11 else None, i % 5, i % 4, 1 + i % 5 if i % 13 else None, i * 7 % 50, (i * 37 % 100) / 100, int(i * 37 % 100 >= 50), 1.0 + i % 4, texts[i % 4])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "row_id long, item string, user_id long, day_no int, star int, likes int, p_pos double, pred_sent int, exp_rating double, comment string")


def kinds(rows):
    mentions = A.aspect_mentions(rows, lambda c: F.length(c) / 40.0, CFG.aspects)
    return rows, mentions, X.spam_detail(X.signal_base(rows.filter("item IS NOT NULL AND star IS NOT NULL"), CFG.spam), CFG.spam)


def same(a, b, digits=9):
    def norm(df):
        names = sorted(df.columns)
        return sorted(str([round(r[c], digits) if isinstance(r[c], float) else r[c] for c in names]) for r in df.collect())

    assert norm(a) == norm(b)


def test_states_merge_to_the_whole(spark, tmp_path):
    rows, mentions, detail = kinds(scored(spark))
    Z.write_all(rows, mentions, detail, str(tmp_path), CFG)
    read = {k: Z.read_states(spark, f"{tmp_path}/{k}") for k in Z.KINDS}
    same(Z.merged_items(read["items"]), R.item_stats(rows))
    same(Z.merged_aspects(read["aspects"]), A.aspect_rates(mentions))
    same(Z.merged_evidence(read["evidence"], CFG), A.aspect_evidence(mentions, CFG.aspects))
    same(Z.merged_words(read["words"]), K.word_bags(rows, CFG.keywords, word_tokens))
    same(Z.merged_spam(read["spam"]), X.spam_summary(detail))
    same(Z.merged_suspects(read["suspects"], CFG), X.rank_suspects(detail, CFG.spam))
    page = Z.item_page(spark, str(tmp_path), "m1", CFG).collect()
    assert [r["item"] for r in page] == ["m1"] and page[0]["by_type"].keys() == set(C.SIGNALS)
    assert Z.item_page(spark, str(tmp_path), "unknown", CFG).count() == 0


def test_a_segment_is_replaced(spark, tmp_path):
    path, rows = str(tmp_path), scored(spark)
    Z.write_states(Z.item_states(rows, CFG), path, CFG)
    changed = rows.filter("row_id NOT BETWEEN 20 AND 29").withColumn("star", F.when(F.col("row_id") < 10, 1).otherwise(F.col("star")))
    Z.write_states(Z.item_states(changed.filter("row_id < 30"), CFG), path, CFG, 0, 30)
    same(Z.merged_items(Z.read_states(spark, path)), R.item_stats(changed))  # segment 2 is empty now
    Z.write_states(Z.item_states(rows.filter("row_id < 30"), CFG), path, CFG, 0, 30)
    same(Z.merged_items(Z.read_states(spark, path)), R.item_stats(rows))
    for bounds in ((5, 10), (0, None), (0, 15)):
        with pytest.raises(ValueError):
            Z.write_states(Z.item_states(rows, CFG), path, CFG, *bounds)


def test_no_rows(spark, tmp_path):
    Z.write_states(Z.item_states(scored(spark).limit(0), CFG), str(tmp_path), CFG, 0, 20)
    assert Z.merged_items(spark.read.schema("item string, n long, star_pos long, star_neg long, star_mid long, model_pos long, model_neg long, "
        + ", ".join(f"{c}_sum double, {c}_count long" for c in Z.AVERAGED)).parquet(str(tmp_path)).filter("n > 0")).count() == 0


def test_a_segment_is_one_file(spark, tmp_path):
    """every task wrote a file into every segment."""
    path = str(tmp_path / "s")
    rows = spark.range(0, 1000, 1, 8).selectExpr("id % 10 AS segment", "id AS item", "1L AS n")
    Z.write_states(rows.repartition(8, "item"), path, Z.StateConfig(100), 0, 1000)
    files = [f for f in tmp_path.rglob("segment=*/*.parquet")]
    assert len(files) == 10 and Z.read_states(spark, path).count() == 1000
