import numpy as np
import pandas as pd
import pytest
import re
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.operators import spam as X
from plaudit.operators.scale import stable_copy

SCHEMA = "row_id bigint, item string, user_id string, day_no int, star int, likes int, comment string, p_pos double"


def make_rows(n=600):
    """A third of the rows copy one text; others are near copies, adverts, symbols."""
    rows = []
    for i in range(n):
        text = f"这部电影真的很好看第{i}次推荐给大家"
        if i % 3 == 0:
            text = "好看好看真的好看一定要去看啊啊啊啊"
        elif i % 11 == 0:
            text = "开头都是一样的十二个字呀" + str(i)
        elif i % 13 == 0:
            text = "加微信 看资源 " + str(i)
        elif i % 17 == 0:
            text = "！！！😀😀"
        elif i % 19 == 0:
            text = "好！" + str(i % 3) + "。。"
        star = i % 5 + 1
        p = None if i % 23 == 0 else (0.95 if i % 2 else 0.05)
        user = None if i % 29 == 0 else f"u{i % 40}"
        rows.append((i, f"m{0 if i % 2 else i % 6}", user, i % 7 if i % 4 else 3, star, (i * 37) % 500, text, p))
    return rows


def brute(rows, cfg):
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    df["user_id"] = df.user_id.fillna("nan")
    norm = df.comment.map(lambda s: re.sub(C.NON_WORD_PATTERN, "", s))
    df["norm"] = norm
    size = lambda keys: df.groupby(keys).row_id.transform("size")
    df["dup"] = size(["item", "norm"])
    df["items"] = df.groupby("norm").item.transform("nunique")
    df["total"] = size(["norm"])
    df["tmpl"] = norm.map(lambda s: re.sub(C.REPEAT_PATTERN, r"\1", s)[:12] if len(s) >= 12 else "")
    df["tsize"] = np.where(df.tmpl != "", size(["item", "tmpl"]), 0)
    df["uid"], df["ui"] = size(["user_id", "item", "day_no"]), size(["user_id", "item"])
    df["day"] = size(["item", "day_no"])
    cut = np.percentile(df.day, 99.9)
    label = np.where(df.star >= 4, 1, np.where(df.star <= 2, 0, -1))
    flags = {
        "dup_same_movie": df.dup >= 2, "dup_cross_movie": (df["items"] >= 3) & (df.total >= 3),
        "template": df.tsize >= 5, "ad": df.comment.map(lambda s: bool(re.search(C.AD_PATTERN, s, re.I))),
        "user_burst": df.uid >= 5, "user_repeat": df.ui >= 3, "movie_day_burst": df.day > cut,
        "rating_mismatch": ((df.p_pos >= 0.9) & (label == 0)) | ((df.p_pos <= 0.1) & (label == 1)),
        "like_bomb": (df.likes >= 300) & (df.comment.str.len() <= 15), "low_info": norm.str.len() <= 5,
    }
    score = sum(C.SIGNAL_WEIGHTS[k] * v.astype(int) for k, v in flags.items()).clip(0, 100)
    reasons = ["|".join(k for k in flags if flags[k][i]) for i in range(len(df))]
    return df, score, reasons, cut


@pytest.fixture(scope="module")
def rows():
    return make_rows()


def test_detail_matches_brute_force(spark, rows, join_mode):
    cfg = C.SpamConfig()
    base = stable_copy(X.signal_base(spark.createDataFrame(rows, SCHEMA), cfg))
    got = X.spam_detail(base, cfg).orderBy("row_id").collect()
    df, score, reasons, cut = brute(rows, cfg)
    assert [r.spam_points for r in got] == score.tolist()
    assert ["|".join(r.reasons) for r in got] == reasons
    for col, name in {"dup": "dup_same_movie_size", "items": "text_movie_count", "total": "text_total_count",
                      "tsize": "template_size", "ui": "user_movie_count", "uid": "user_movie_day_count", "day": "movie_day_count"}.items():
        assert [r[name] for r in got] == df[col].tolist(), name
    assert got[0].day_burst_p999 == cut
    assert {"dup_same_movie", "dup_cross_movie", "template", "ad", "user_repeat", "rating_mismatch", "low_info"} <= set("|".join(reasons).split("|"))
    features = X.user_features(base).orderBy("row_id").collect()
    assert [r.user_total for r in features] == df.groupby("user_id").row_id.transform("size").tolist()


def test_summary_and_suspects(spark, rows):
    cfg = C.SpamConfig()
    reviews = spark.createDataFrame(rows, SCHEMA)
    detail = stable_copy(X.spam_detail(stable_copy(X.signal_base(reviews, cfg)), cfg))
    df, score, reasons, _ = brute(rows, cfg)
    summary = {r["item"]: r for r in X.spam_summary(detail).collect()}
    for item, part in df.assign(score=score).groupby("item"):
        assert summary[item].n_reviews == len(part)
        assert summary[item].n_suspect == (part.score >= 50).sum()
        assert summary[item].mean_spam_score == pytest.approx(part.score.mean() / 100)
    top = X.suspect_texts(X.rank_suspects(detail, cfg), reviews, cfg)
    best = df.assign(score=score)[score >= 50].sort_values(["score", "likes", "row_id"], ascending=[False, False, True])
    truth = {(i, r) for _, part in best.groupby("item") for i, r in zip(part.item[:8], part.row_id[:8])}
    assert {(r["item"], r.row_id) for r in top.collect()} == truth
    nested = X.nested_spam_summary(X.spam_summary(detail), top).collect()
    assert all(t.reasons for r in nested for t in r.top_suspects)
    assert all(sum(r.by_type.values()) >= r.n_suspect for r in nested)
    totals = X.site_totals(X.spam_summary(detail)).first()
    assert totals.n_reviews == len(rows) and totals.n_suspect == (score >= 50).sum()


def test_empty_norm_option(spark):
    rows = [(i, "m", f"u{i}", 0, 3, 0, "！！！！😀", None) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    for ignore in (False, True):
        cfg = C.SpamConfig(ignore_empty=ignore)
        out = X.spam_detail(stable_copy(X.signal_base(df, cfg)), cfg).collect()
        assert {r.dup_same_movie for r in out} == {not ignore}


def test_weights_and_days(spark):
    assert all(0 < w <= 100 for w in C.SIGNAL_WEIGHTS.values())
    assert C.SIGNAL_WEIGHTS["dup_same_movie"] >= 50 and C.SIGNAL_WEIGHTS["ad"] >= 50
    df = spark.createDataFrame([("1970-01-02",), ("bad",), (None,)], "d string")
    assert [r.v for r in df.select(X.day_number(F.col("d")).alias("v")).collect()] == [1, -1, -1]
