import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.operators import aspects as A
from plaudit.operators import lexicon as L
from plaudit.operators import word_search as S


def brute(texts, words):
    def has(text, w):
        return (w.lower() in text.lower()) if w.isascii() else (w in text)

    return {(i, a, w) for i, t in texts if t for a, w in words if a is not None and w and has(t, w)}


def found(spark, texts, words):
    rows = spark.createDataFrame(texts, "id long, t string")
    lexicon = spark.createDataFrame(words, "aspect string, keyword string")
    return {tuple(r) for r in L.contains_join(rows, ["id"], "t", lexicon).collect()}


@pytest.mark.parametrize("chunk", [L.CHUNK, 4])
def test_against_contains(spark, monkeypatch, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    rnd = random.Random(chunk)
    make = lambda n: "".join(rnd.choice("abAB cé漢😀") for _ in range(n))
    texts = [(i, make(rnd.randint(0, 60))) for i in range(150)] + [(900, None), (901, ""), (902, "a"), (903, "ab"), (904, make(900))]
    words = [(f"x{k % 4}", make(rnd.randint(1, 9))) for k in range(120)] + [("x0", ""), ("x1", None), (None, "ab"), ("x2", "ab"), ("x3", "ab"), ("x2", "ab")]
    assert found(spark, texts, words) == brute(texts, words)


def test_borders_of_chunks(spark):
    text = "".join(chr(97 + i * 7 % 26) + chr(0x4E00 + i % 900) for i in range(1000))
    words = [("w", text[i : i + n]) for i in (0, 1, 253, 254, 255, 256, 257, 510, 511, 512, 1990) for n in (1, 2, 3, 4, 9)]
    assert found(spark, [(1, text)], words) == brute([(1, text)], words)


def test_no_lexicon_and_no_texts(spark):
    assert found(spark, [(1, "abc")], []) == set() and found(spark, [], [("a", "b")]) == set()


def test_mentions_as_with_the_literal_lexicon(spark):
    texts = ["Plot is good, the PLOT is long. Music!", "no hit at all", None, "music and plot; plot, plot", "музыка plot"]
    reviews = spark.createDataFrame([(i, "m", i, t) for i, t in enumerate(texts)], "row_id long, item string, likes int, comment string")
    words = {"story": ("plot", "long"), "sound": ("music", "музыка")}
    cfg = C.AspectConfig(lexicon=words, clause_pattern="[,.!;]+")
    table = spark.createDataFrame([(a, k) for a, ks in words.items() for k in ks], "aspect string, keyword string")
    score = lambda c: F.length(c) / 100.0
    columns = ["row_id", "item", "likes", "clause", "p", "aspect"]
    want = A.aspect_mentions(reviews, score, cfg).select(columns).collect()
    assert sorted(map(tuple, L.lexicon_mentions(reviews, score, table, cfg).select(columns).collect())) == sorted(map(tuple, want)) and want


def test_large_lexicon_is_joined_by_hash_and_sort_alone(spark):
    """20,000 keywords: no nested loop; the only broadcast sides are bitmaps."""
    lexicon = spark.range(20_000).selectExpr("concat('a', id % 7) AS aspect", "concat('w', hex(id * 7919), 'z') AS keyword")
    rows = spark.range(3_000).selectExpr("id", "concat('say w', hex(id * 7919), 'z, and w', hex(id * 5), 'z') AS t")
    got = L.contains_join(rows, ["id"], "t", lexicon)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and got._jdf.queryExecution().executedPlan().toString().count("NestedLoop") == 0
    assert got.filter("keyword = concat('w', hex(id * 7919), 'z')").count() == 3_000


def test_matches_of_texts_in_one_piece_are_not_shuffled(spark):
    """A text in one piece under its own keys needs no ``distinct``; others come out once still."""
    texts = [(1, "Abab long ab"), (2, "ab " * 300), (3, "ab"), (3, "long AB"), (None, "a long"), (None, "long a"), (4, None)]
    words = [("x", "ab"), ("y", "ab"), ("x", "long ab"), ("z", "b ab ab ab")]
    rows = spark.createDataFrame(texts, "id long, t string")
    got = L.contains_join(rows, ["id"], "t", spark.createDataFrame(words, "aspect string, keyword string"))
    assert sorted(map(str, got.collect())) == sorted(map(str, [Row(id=i, aspect=a, keyword=w) for i, a, w in brute(texts, words)]))
    direct, rest = got._jdf.queryExecution().optimizedPlan().children().apply(0), got._jdf.queryExecution().optimizedPlan().children().apply(1)
    assert "Aggregate [id" not in direct.toString() and "Aggregate [id" in rest.toString()


def test_words_on_bytes_against_contains(monkeypatch):
    """Short words, words in blocks that share their beginning, words over the end of a text, and
    texts longer than a slice."""
    rnd = random.Random(3)
    for _ in range(120):
        letters = rnd.choice(["ab", "ab\0c", "abcdefg h", "aé漢😀", "é漢"])
        make = lambda n: "".join(rnd.choice(letters) for _ in range(n))
        texts = [None if rnd.random() < 0.05 else make(rnd.randint(0, 80)) for _ in range(rnd.randint(0, 50))] + [make(1500)]
        words = {make(rnd.choice([1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 24, 25, 30])).encode(): 0 for _ in range(50)}
        words = {w: i for i, w in enumerate([*words, (texts[-1][3:60]).encode()])}
        monkeypatch.setattr(S, "SLICE", rnd.choice([8, 100, 1 << 16]))
        monkeypatch.setattr(S, "SLICE_ROWS", rnd.choice([1, 7, 8192]))
        column = pa.array([None, "a", *texts], pa.string()).slice(2)
        got = {(start + (int(p) >> S.ROW_AT), int(p) & S.ID_MASK) for start, _, found in S.search([(S.Words(words), column)]) for p in found}
        assert got == {(r, i) for r, t in enumerate(texts) if t for w, i in words.items() if w in t.encode()}


REPEATED = [(1, 0, "Abab long ab"), (1, 1, "ab " * 300), (1, 2, "x"), (2, 0, "ab"), (2, 0, "long AB"), (2, 70, "b ab long"), (2, None, "ab"),
            (None, 0, "a long"), (None, 0, "long a"), (None, 1, "été"), (4, 0, None), (1, 90, "Été ab"), (2, 1, "ab"), (5, 3, "aB"), (5, 2, "ab")]
WORDS = [("x", "ab"), ("y", "ab"), ("x", "AB"), ("x", "long ab"), ("z", "b ab ab ab ab"), ("z", "Été"), ("y", "a")]


@pytest.mark.parametrize("held", [1 << 17, -1])
def test_matches_and_their_counts_for_both_sizes_of_a_lexicon(spark, monkeypatch, held):
    """Repeated and null keys count once, also if only some texts of a review repeat their keys."""
    monkeypatch.setattr(L, "HELD_WORDS", held)
    rows = spark.createDataFrame(REPEATED, "id long, pos int, t string")
    lexicon = spark.createDataFrame(WORDS, "aspect string, keyword string")
    want = brute([((i, p), t) for i, p, t in REPEATED], WORDS)
    got = L.contains_join(rows, ["id", "pos"], "t", lexicon).collect()
    assert len(got) == len(want) and {((r.id, r.pos), r.aspect, r.keyword) for r in got} == want
    counts = L.contains_join(rows, ["id", "pos"], "t", lexicon, per=["id"])
    assert counts.columns == ["id", "aspect", "keyword", "n"]
    assert sorted(map(str, map(tuple, counts.collect()))) == sorted(str((*k, n)) for k, n in Counter((i, a, w) for (i, _), a, w in want).items())


def test_counts_of_a_review_over_several_slices(spark):
    n = 2 * S.SLICE_ROWS + 10
    rows = spark.range(n + 500).selectExpr(f"if(id < {n}, 7, id) AS id", "cast(id AS int) AS pos", "if(id % 3 = 0, 'ab', 'c') AS t").coalesce(1)
    lexicon = spark.createDataFrame([("x", "ab"), ("y", "c"), ("x", "b")], "aspect string, keyword string")
    counts = L.contains_join(rows, ["id", "pos"], "t", lexicon, per=["id"])
    want = (n + 2) // 3
    assert sorted(map(tuple, counts.filter("id = 7").drop("id").collect())) == [("x", "ab", want), ("x", "b", want), ("y", "c", n - want)]
    assert counts.filter("id <> 7").count() == sum(2 if i % 3 == 0 else 1 for i in range(n, n + 500))


def test_counting_query_makes_no_row_per_match(spark, tmp_path):
    """Matches are counted in the batches that find them; only parts of a review are summed."""
    rows = spark.range(40).selectExpr("id", "explode(sequence(0, 99)) AS pos").selectExpr("id", "pos", "concat('ab ', pos) AS t").coalesce(2)
    rows.write.parquet(str(tmp_path / "rows"))
    lexicon = spark.createDataFrame([("x", "ab"), ("y", "a")], "aspect string, keyword string")
    counts = L.contains_join(spark.read.parquet(str(tmp_path / "rows")), ["id", "pos"], "t", lexicon, per=["id"])
    assert "pos" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, counts.collect())) == sorted((i, a, w, 100) for i in range(40) for a, w in (("x", "ab"), ("y", "a")))


@pytest.mark.parametrize("held", [1 << 17, -1])
def test_mentions_under_repeated_keys(spark, monkeypatch, held):
    """Clauses at the same place of reviews with the same id share their aspects; without an id there are none."""
    monkeypatch.setattr(L, "HELD_WORDS", held)
    texts = [(1, "plot one, music"), (1, "song, music"), (2, "plot, plot, song"), (None, "plot"), (3, "none")]
    reviews = spark.createDataFrame([(i, "m", 1, t) for i, t in texts], "row_id long, item string, likes int, comment string")
    table = spark.createDataFrame([("story", "plot"), ("sound", "music"), ("sound", "song"), ("all", "o")], "aspect string, keyword string")
    got = L.lexicon_mentions(reviews, lambda c: F.length(c) / 100.0, table, C.AspectConfig(clause_pattern="[,.!;]+", min_clause_chars=3))
    assert sorted(map(tuple, got.select("row_id", "pos", "clause", "aspect").collect())) == sorted([
        (1, 0, "plot one", "all"), (1, 0, "plot one", "sound"), (1, 0, "plot one", "story"), (1, 0, "song", "all"), (1, 0, "song", "sound"),
        (1, 0, "song", "story"), (1, 1, "music", "sound"), (1, 1, "music", "sound"), (2, 0, "plot", "all"), (2, 0, "plot", "story"),
        (2, 1, "song", "all"), (2, 1, "song", "sound"), (3, 0, "none", "all")])


def test_mentions_of_clauses_under_keys_of_their_own_are_not_joined(spark):
    reviews = spark.range(50).selectExpr("id AS row_id", "'m' AS item", "1 AS likes", "'plot, music' AS comment")
    table = spark.createDataFrame([("story", "plot"), ("sound", "music")], "aspect string, keyword string")
    got = L.lexicon_mentions(reviews, lambda c: F.length(c) / 100.0, table, C.AspectConfig(clause_pattern="[,.!;]+"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and got.count() == 100
