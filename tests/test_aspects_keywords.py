import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions.scoring import lexicon_p_pos, like_weight
from plaudit.operators import aspects as A
from plaudit.operators import keywords as K
from plaudit.operators.scale import top_per_group

LEX = C.SentimentLexicon()
REVIEWS = [
    (1, "m1", 10, "剧情精彩，演技出色，画面惊艳，配乐好听"),
    (2, "m1", 0, "剧情无聊，剧情无聊，节奏拖沓"),
    (3, "m2", 5, "结局失望，剧情很差"),
    (4, "m2", 0, "没有命中的句子"),
    (5, "m1", -3, "故事喜欢，故事精彩"),
]
CFG = C.AspectConfig(min_mentions=1)


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(REVIEWS, "row_id bigint, item string, likes int, comment string")


@pytest.fixture(scope="module")
def mentions(reviews):
    return A.aspect_mentions(reviews, lambda c: lexicon_p_pos(c, LEX), CFG).cache()


def test_mentions(mentions):
    got = {(r.row_id, r.clause, r.aspect) for r in mentions.collect()}
    assert got == {
        (1, "剧情精彩", "剧情故事"), (1, "演技出色", "演技表演"), (1, "画面惊艳", "画面特效"), (1, "配乐好听", "配乐音效"),
        (2, "剧情无聊", "剧情故事"), (2, "节奏拖沓", "节奏剪辑"),
        (3, "结局失望", "结局结尾"), (3, "剧情很差", "剧情故事"),
        (5, "故事喜欢", "剧情故事"), (5, "故事精彩", "剧情故事"),
    }


def test_rates_and_evidence(mentions):
    rates = {(r["item"], r.aspect): r for r in A.aspect_rates(mentions).collect()}
    story = rates[("m1", "剧情故事")]
    rows = [(2 / 3, 10), (1 / 3, 0), (2 / 3, -3), (2 / 3, -3)]
    w = [1 + math.log1p(max(0, l)) for _, l in rows]
    assert story.mentions == 4 and story.pos_rate == pytest.approx(sum(p for p, _ in rows) / 4)
    assert story.like_weighted_pos_rate == pytest.approx(sum(a * p for a, (p, _) in zip(w, rows)) / sum(w))
    top = A.aspect_evidence(mentions, CFG).filter("item = 'm1' and aspect = '剧情故事' and polarity = 'pos'")
    assert [r.clause for r in top.orderBy("rank").collect()] == ["剧情精彩", "故事喜欢", "故事精彩"]


def test_pros_cons_weak(spark, mentions, reviews):
    table = A.aspect_table(mentions, CFG)
    out = {r["item"]: r for r in A.pros_and_cons(table, reviews, cfg=CFG).collect()}
    assert {p.aspect for p in out["m1"].pros} == {"演技表演", "画面特效", "配乐音效"}
    assert [c.aspect for c in out["m1"].cons] == ["节奏剪辑"] and out["m1"].weak == []
    assert {c.aspect for c in out["m2"].cons} == {"结局结尾", "剧情故事"}
    assert out["m1"].n_sampled == 3 and out["m1"].cons[0].evidence == ["节奏拖沓"]
    soft = C.AspectConfig(min_mentions=1, negative_rate=0.1)
    weak = A.weak_points(A.aspect_rates(mentions), soft).filter("item = 'm1'").orderBy("rank").collect()
    assert [w.aspect for w in weak] == ["节奏剪辑", "剧情故事"]
    nested = A.aspects_by_item(table, reviews).filter("item = 'm1'").first()
    assert nested.aspects[0].aspect == "剧情故事" and nested.n_sampled == 3


def test_log_odds_matches_formula(spark, join_mode):
    texts = [("m1", 1, "aa bb aa cc"), ("m1", 0, "bb bb cc dd"), ("m2", 1, "aa dd dd"), ("m2", 0, "cc aa zz z")] * 3
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "row_id bigint, item string, pred_sent int, comment string")
    cfg = C.KeywordConfig(stop_words=("zz",), min_count=3)
    got = {(r["item"], r.word): r for r in K.log_odds(K.word_bags(df, cfg), cfg).collect()}
    bags, bg = {}, Counter()
    for item, sent, text in texts:
        for w in text.split():
            if len(w) >= 2 and w != "zz":
                bags.setdefault((item, sent), Counter())[w] += 1
                bg[w] += 1
    n, seen = sum(bg.values()), set()
    for item in ("m1", "m2"):
        pos, neg = bags[(item, 1)], bags[(item, 0)]
        for w in set(pos) | set(neg):
            y, x = pos[w], neg[w]
            if y + x < 3:
                continue
            a, a0 = 0.01 * bg[w], 0.01 * n
            d = math.log((y + a) / max(1e-9, sum(pos.values()) + a0 - y - a)) - math.log((x + a) / max(1e-9, sum(neg.values()) + a0 - x - a))
            assert got[(item, w)].z == pytest.approx(d / math.sqrt(1 / (y + a) + 1 / (x + a)))
            seen.add((item, w))
    assert set(got) == seen
    top = K.top_keywords(K.log_odds(K.word_bags(df, cfg), cfg), cfg)
    lists = {r["item"]: r for r in K.keyword_lists(top, cfg).collect()}
    assert lists["m1"].keywords_pos[0] == "aa" and lists["m1"].keywords_neg[0] in ("bb", "dd")


def test_tokenizer_can_be_replaced(spark):
    df = spark.createDataFrame([(1, "m", 1, "a|bb|ccc")], "row_id bigint, item string, pred_sent int, comment string")
    bags = K.word_bags(df, tokenize=lambda c: F.split(c, r"\|"))
    assert {r.word for r in bags.collect()} == {"bb", "ccc"}


@pytest.mark.parametrize("large", [0, 5, 10_000])
def test_evidence_sorts_only_the_strongest(spark, monkeypatch, large):
    """Large groups are cut first; ties, equal rows, missing scores and items come out as without."""
    monkeypatch.setattr(A, "LARGE_GROUP", large)
    rows = [(i % 90, None if i % 11 == 0 else f"m{i % 3}", f"c{i % 17}", f"a{i % 2}", None if i % 13 == 0 else (i * 7 % 10) / 10, i % 4) for i in range(300)]
    mentions = spark.createDataFrame([*rows, *rows[:40]], "row_id long, item string, clause string, aspect string, p double, likes int").cache()
    polar = mentions.withColumn("polarity", F.when(F.col("p") >= 0.5, "pos").otherwise("neg"))
    polar = polar.withColumn("strength", 2 * F.abs(F.col("p") - 0.5) * like_weight(F.col("likes")))
    group = ["item", "aspect", "polarity"]
    want = top_per_group(polar, group, [F.desc("strength"), F.asc("clause"), F.asc("row_id")], CFG.evidence)
    got = A.aspect_evidence(mentions, CFG)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    left = A._strongest(polar, group, 1).filter("item IS NOT NULL").count()
    assert (left < 200) == (large < 10_000)
