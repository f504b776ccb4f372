import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions import text as T
from plaudit.functions import scoring as S

CLEANED = {
    "read http://q.test/p?x=1#y today": "read today",
    "www.shop.test/灯 end": "end",
    "left\x01right\x1f": "leftright",
    "\u3000wide\u3000space\u3000": "wide space",
    "one\ttwo\r\nthree": "one two three",
    " \n ": "",
    "": "",
    "hard\u00a0space": "hard space",
}


def _column(spark, expr, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_clean_text(spark):
    assert _column(spark, T.clean_text, list(CLEANED)) == list(CLEANED.values())


def test_normal_form_and_opening(spark):
    assert _column(spark, T.normalize_text, ["A-b c!", "灯火，1 盏。", "é😀", ""]) == ["Abc", "灯火1盏", "", ""]
    openings = {"short": None, "z" * 11: None, "z" * 12: "z", "mmmmnopqrstuvwxyz": "mnopqrstuvwx", "aabbaabbaabb": "aabbaabbaabb"}
    assert _column(spark, lambda c: T.template_head(c, 12), list(openings)) == list(openings.values())


def test_adverts(spark):
    adverts = {"加VX领券": True, "http www.deal.test": True, "灯光柔和，镜头安静": False, "wxyz is no contact": False, "找 @店主 问": True}
    got = dict(zip(adverts, _column(spark, T.is_advert, list(adverts))))
    assert got == {t: bool(re.search(C.AD_PATTERN, t, re.I)) for t in adverts}
    assert not got["灯光柔和，镜头安静"]


def test_clauses(spark):
    cfg = C.AspectConfig()
    rows = _column(spark, lambda c: T.clauses(c, cfg.clause_pattern, 3), ["灯光柔和，镜头安静！短。尾声悠长"])
    assert rows == [["灯光柔和", "镜头安静", "尾声悠长"]]


def test_aspects_of_a_clause(spark):
    lexicon = {"light": ("灯光", "lamp"), "sound": ("Echo", "回声"), "pace": ("慢",)}
    clauses = ["灯光与回声", "LAMP on", "an echo", "nothing", "慢慢"]
    assert _column(spark, lambda c: T.clause_aspects(c, lexicon), clauses) == [["light", "sound"], ["light"], ["sound"], [], ["pace"]]


def test_aspect_keywords_are_disjoint():
    words = [set(w) for w in C.AspectConfig().lexicon.values()]
    assert len(set().union(*words)) == sum(map(len, words))


def test_hit_clauses(spark):
    every = C.AspectConfig(lexicon={"a": ("xx",), "b": ("yy",)}, clause_pattern=",")
    text = ["xx1,xx1,none,yyxx,xx2,xx3,yy4"]
    pairs = lambda cfg: [(r.clause, r.aspects) for r in _column(spark, lambda c: T.hit_clauses(c, cfg), text)[0]]
    want = [("xx1", ["a"]), ("yyxx", ["a", "b"]), ("xx2", ["a"]), ("xx3", ["a"]), ("yy4", ["b"])]
    assert pairs(every) == want
    assert pairs(replace(every, clauses_per_review=3)) == want[:3]


def test_tokens(spark):
    got = _column(spark, T.word_tokens, ["Red lamp灯火红 é2x 夜", ""])
    assert got == [["red", "lamp", "灯火", "火红", "灯火红", "é", "x"], []]


def test_labels_and_scores(spark):
    df = spark.createDataFrame([(s,) for s in (1, 2, 3, 4, 5)], "star int")
    assert [r.v for r in df.select(S.star_label(F.col("star")).alias("v")).collect()] == [0, 0, -1, 1, 1]
    lex = C.SentimentLexicon()
    p = _column(spark, lambda c: S.lexicon_p_pos(c, lex), ["喜欢，精彩", "垃圾，无聊", "没有词"])
    assert p == [0.75, 0.25, 0.5]


def test_rating_distribution(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3, 0.3, 0.1],), ([0.0, 0.0, 0.0, 0.0, 1.0],)], "d array<double>")
    rows = df.select(
        S.expected_rating(F.col("d")).alias("e"), S.best_rating(F.col("d")).alias("b"), S.best_rating_p(F.col("d")).alias("p")
    ).collect()
    assert rows[0].e == pytest.approx(3.1) and rows[0].b == 3 and rows[0].p == 0.3
    assert (rows[1].e, rows[1].b, rows[1].p) == (5.0, 5, 1.0)
    total = spark.range(1, 10).select(F.aggregate(S.binomial_ratings(F.col("id") / 10), F.lit(0.0), lambda a, x: a + x).alias("t"))
    assert all(r.t == pytest.approx(1.0) for r in total.collect())


def test_split_needs_no_big_numbers(spark):
    ids = [0, 1, 999, 12345, 2**31 + 5, 10**12 + 7, 2**62]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = [(r.b, r.h) for r in df.select(S.split_bucket(F.col("id")).alias("b"), S.spread_hash(F.col("id"), 3).alias("h")).collect()]
    m = C.HASH_MULTIPLIER
    assert got == [((i * m) % 1000, (((i + 3) % 2**31) * m) % 2**32) for i in ids]


def test_fast_forms_equal_the_plain_patterns(spark):
    """the same results as the patterns as they stand, on odd texts."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aaabbbWwvVxX 1Éß漢一龥𠀀\n\t.,@hQ微信加我") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["", None, "a" * 40_000, "aab" * 9, "see WWW.x", "wx", "awx", "v信", "x@y", "\x00a\x7f"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    plain = F.regexp_replace("t", C.NON_WORD_PATTERN + "+", "")
    squeezed = F.when(F.length(plain) >= 12, F.substring(F.regexp_replace(plain, C.REPEAT_PATTERN, "$1"), 1, 12))
    norm = T.normalize_text(F.col("t"))
    pairs = [(norm, plain), (T.template_head(norm, 12), squeezed), (T.is_advert(F.col("t")), F.col("t").rlike("(?iU)" + C.AD_PATTERN))]
    assert rows.filter(~F.forall(F.array(*[a.eqNullSafe(b) for a, b in pairs]), lambda x: x)).count() == 0


def test_whole_text_is_not_squeezed_for_its_opening(spark):
    rows = spark.createDataFrame([("ab" * 50_000,)], "n string").select(F.regexp_extract("n", r"(?s)^(?:(.)\1*+){1,12}+", 0).alias("r"), T.template_head(F.col("n"), 12).alias("h"))
    assert rows.first() == ("ab" * 6, "ab" * 6)


def test_aspects_search_plainly(spark):
    """F10 to F14: one pattern per aspect was tried at every character."""
    made = spark.createDataFrame([("a.b THIS",), ("axb",), ("é漢",)], "c string")
    tests = T.clause_aspects(F.col("c"), {"dot": ("a.b",), "word": ("this", "漢")})
    assert [r.a for r in made.select(tests.alias("a")).collect()] == [["dot", "word"], [], ["word"]]
    assert "RLIKE" not in made.select(tests)._jdf.queryExecution().analyzed().toString()


def test_frequent_characters_start_no_match(spark):
    """What makes up most of a text (plain spaces, letters beyond ASCII, letters that begin no word)
    is told apart by one look at a character, with the results of the plain patterns."""
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(" \t\n　\u0085\x1c\x0baéſKtheWX微信.@") for _ in range(rnd.randint(0, 16))) for _ in range(2000)]
    words = spark.createDataFrame([(t,) for t in [*texts, "the-end the", "xthe the!the"]], "t string")
    lex = C.SentimentLexicon(positive=("the", "he-", "é^"), negative=("a]", "e"), whole_words=True)
    bare = F.regexp_replace(F.regexp_replace("t", C.CONTROL_PATTERN, ""), r"(?U)\s+", " ")
    hits = [F.regexp_count(F.lower("t"), F.lit(f"(?<![a-z])(?:{T.any_of(w)})(?![a-z])")) for w in (lex.positive, lex.negative)]
    pairs = [(T.clean_text(F.col("t")), F.trim(bare)), (T.normalize_text(F.col("t")), F.regexp_replace("t", C.NON_WORD_PATTERN, "")),
             (T.is_advert(F.col("t")), F.col("t").rlike(f"(?iU)(?:{C.AD_PATTERN})")), *zip(S.lexicon_counts(F.col("t"), lex), hits)]
    for got, want in pairs:
        assert words.filter(~got.eqNullSafe(want)).count() == 0
    assert "\\x{80}" not in C.AD_FIRST and S.lexicon_counts(F.col("t"), lex)[0]._jc.toString().count("(?=[")
