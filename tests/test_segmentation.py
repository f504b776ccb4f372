import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions.text import word_tokens
from plaudit.operators import keywords as K
from plaudit.operators import segmentation as G

WORDS = ["山水", "河流", "天空", "大地之", "火车站台", "书"]
CONFIG = C.SegmentConfig(min_count=10, min_pmi=1.5, min_entropy=0.9)


def corpus(n=600, seed=1):
    """Runs of three to six words from a list, in any order, between spaces and letters."""
    rnd = random.Random(seed)
    cuts = [[[rnd.choice(WORDS) for _ in range(rnd.randint(3, 6))] for _ in range(2)] for _ in range(n)]
    return [f"{''.join(a)} Ab {''.join(b)}." for a, b in cuts], [a + b for a, b in cuts]


def reviews(spark, texts):
    rows = [(i, "x" if i % 2 else "y", i % 3 == 0 and 1 or 0, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "row_id long, item string, pred_sent int, comment string")


def all_cuts(run, known, longest):
    for marks in itertools.product([0, 1], repeat=len(run) - 1):
        parts, start = [], 0
        for i, m in enumerate([*marks, 1], 1):
            if m:
                parts.append(run[start:i])
                start = i
        if all(len(p) == 1 or p in known for p in parts) and max(map(len, parts)) <= longest:
            yield parts


def test_best_path_against_all_cuts():
    rnd = random.Random(9)
    for _ in range(300):
        known = {"".join(rnd.choice("甲乙丙") for _ in range(rnd.randint(1, 3))): -rnd.randint(1, 6) for _ in range(12)}
        longest, unseen = max(map(len, known)), min(known.values()) - 2
        run = "".join(rnd.choice("甲乙丙丁") for _ in range(rnd.randint(1, 9)))
        key = lambda parts: (sum(known.get(p, unseen) for p in parts), -len(parts), [len(p) for p in parts])
        want = max(all_cuts(run, known, longest), key=key)
        assert G.best_path(run, known, longest, unseen) == want
        assert "".join(want) == run


def test_statistics_by_hand(spark):
    rows = reviews(spark, ["甲乙丙", "甲乙丁 甲乙", "丙甲", None, ""])
    counts = {r["gram"]: r["n"] for r in G.gram_counts(rows).collect()}
    assert counts == {"甲": 4, "乙": 3, "丙": 2, "丁": 1, "甲乙": 3, "乙丙": 1, "乙丁": 1, "丙甲": 1, "甲乙丙": 1, "甲乙丁": 1}
    got = {r["word"]: r for r in G.word_statistics(G.gram_counts(rows), C.SegmentConfig(min_count=3)).collect()}
    assert set(got) == {"甲乙"}
    assert math.isclose(got["甲乙"]["pmi"], math.log(3 * 10 / (4 * 3)))
    assert math.isclose(got["甲乙"]["left_entropy"], math.log(3))  # nothing before it, three ends of runs
    assert math.isclose(got["甲乙"]["right_entropy"], math.log(3))


def test_planted_words_are_found_and_cut(spark):
    texts, cuts = corpus()
    rows = reviews(spark, texts)
    dictionary = G.mine_dictionary(rows, CONFIG)
    found = {r["word"] for r in dictionary.collect() if len(r["word"]) > 1}
    assert {w for w in WORDS if len(w) > 1} <= found
    cut = G.segmenter(dictionary)
    got = {r["row_id"]: r["t"] for r in rows.select("row_id", cut(F.col("comment")).alias("t")).collect()}
    right = 0
    for i, want in enumerate(cuts):
        han = [t for t in got[i] if t != "ab"]
        assert got[i].count("ab") == 1 and "".join(han) == "".join(want)  # every character in exactly one token
        right += han == want
    assert right > 0.95 * len(cuts)


def test_bound_keeps_the_most_frequent(spark):
    rows = reviews(spark, corpus()[0])
    full = G.mine_dictionary(rows, CONFIG).filter(F.length("word") > 1).orderBy(F.desc("n"), "word").collect()
    few = G.mine_dictionary(rows, C.SegmentConfig(min_count=10, min_pmi=1.5, min_entropy=0.9, max_words=2))
    assert [r["word"] for r in few.filter(F.length("word") > 1).orderBy(F.desc("n"), "word").collect()] == [r["word"] for r in full[:2]]


def test_rows_without_ideographs_nulls_and_unseen_characters(spark):
    rows = reviews(spark, ["Plain words, été.", None, "", "12 34"])
    cut = G.corpus_tokenizer(rows)
    assert [r[0] for r in rows.orderBy("row_id").select(cut(F.col("comment"))).collect()] == [["plain", "words", "été"], None, [], []]
    cut = G.segmenter(G.mine_dictionary(reviews(spark, corpus()[0]), CONFIG))
    mixed = reviews(spark, ["龙山水ab龙龙", None, "x" * 50_000 + "山" * 30_000])
    got = [r[0] for r in mixed.orderBy("row_id").select(cut(F.col("comment"))).collect()]
    assert Counter(got[0]) == Counter(["龙", "山水", "ab", "龙", "龙"]) and not got[1]
    assert "".join(got[2][1:]) == "山" * 30_000


def test_keywords_use_words_by_default(spark):
    rows = reviews(spark, corpus()[0])
    cfg = C.KeywordConfig(segments=CONFIG, stop_words=())
    bags = {r["word"] for r in K.word_bags(rows, cfg).collect()}
    grams = {r["word"] for r in K.word_bags(rows, cfg, tokenize=word_tokens).collect()}
    assert {"山水", "火车站台", "ab"} <= bags and "车站" in grams and "车站" not in bags


def test_batches_of_runs_are_bounded_and_repeats_are_cut_once(spark, monkeypatch):
    """whole batches of 10,000 texts became a Python object for each run."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    known = spark.createDataFrame([("甲乙", -1), ("甲", -5), ("乙", -5), ("丙", -5)], "word string, weight long")
    try:
        cut = G.segmenter(known)
        assert int(spark.conf.get(name)) <= 8 << 20
        rows = spark.createDataFrame([(0, "甲乙丙 ab 甲乙丙甲"), (1, None), (2, ""), (3, "cd"), (4, "丁甲乙")], "id long, t string").coalesce(1)
        got = {r.id: list(r.w) for r in rows.select("id", cut(F.col("t")).alias("w")).collect()}
        assert got == {0: ["ab", "甲乙", "丙", "甲乙", "丙", "甲"], 1: [], 2: [], 3: ["cd"], 4: ["丁", "甲乙"]}
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_runs_are_counted_before_they_are_cut(spark):
    """every run of every text was cut into strings."""
    plan = G.gram_counts(reviews(spark, ["甲乙 甲乙"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2
