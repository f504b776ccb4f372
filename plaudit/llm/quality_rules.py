"""Quality rules with risk-controlled thresholds, as column expressions.

A rule rejects a text whose metric lies above a cutoff. The cutoffs are chosen on labelled texts:
per stratum and metric the tightest one for which an exact binomial test still shows that at most
``risk`` of the good texts are rejected. The cutoffs of a metric are tested from the loosest on
(a fixed sequence, so no correction inside it); metrics and strata share the error level evenly.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit.llm.common import GAP, WORD, stored, table, text_of, word_array

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Metric, numerator, denominator, steps per unit (a power of two, so that steps are exact).
METRICS = (
    ("symbols", "n_symbols", "n_words", 32),
    ("upper", "n_upper", "word_chars", 64),
    ("bangs", "n_bangs", "n_words", 32),
    ("repeats", "n_repeat_words", "n_words", 64),
    ("dup_lines", "n_dup_lines", "n_lines", 64),
    ("long_words", "word_chars", "n_words", 4),
)


@dataclass(frozen=True)
class RuleConfig:
    """``risk`` is the share of good texts that all rules together may reject in a stratum, with
    probability 1 - ``error`` in all strata at once. Strata are the languages that have at least
    ``min_share`` of the good labels, so there are at most 1 / ``min_share``; all other rows
    form one more."""

    risk: float = 0.06
    error: float = 0.1
    steps: int = 64
    min_share: float = 0.01
    min_words: int = 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def _removed(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice, overlaps counted once."""

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")),
            lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")),
            lambda a: a["sum"],
        )

    def repeated(pairs: Column) -> Column:
        same = lambda k, o: F.coalesce(F.get(pairs, k + o)["h"] == F.get(pairs, k)["h"], F.lit(False))
        hit = F.filter(pairs, lambda x, k: same(k, F.lit(-1)) | same(k, F.lit(1)))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        several = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(several, covered(_let(pairs, repeated))).otherwise(F.lit(0))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return _let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(windows(w), count))).cast("bigint")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and its counts. One pass over the text, in the scan.

    A null text has no words. Windows are compared by 64-bit hash within one text. Columns of
    the same names that the table has already are replaced.
    """
    t = text_of(text)
    tight = F.translate(t, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    words = _let(word_array(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    counted = F.struct(
        words.alias("w"),
        F.length(tight).cast("bigint").alias("word_chars"),
        _removed(t, SYMBOLS).alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"),
        _removed(t, UPPER).alias("n_upper"),
        _removed(t, "!").alias("n_bangs"),
    )
    new = {
        "n_words": F.col("__c.w.n").cast("bigint"),
        "word_chars": F.col("__c.word_chars"),
        "n_symbols": F.col("__c.n_symbols"),
        "n_lines": F.col("__c.l.n").cast("bigint"),
        "n_dup_lines": F.col("__c.l.d").cast("bigint"),
        "n_repeat_words": F.col("__c.w.r"),
        "n_upper": F.col("__c.n_upper"),
        "n_bangs": F.col("__c.n_bangs"),
    }
    kept = [c for c in docs.columns if c not in new and c != text]
    made = docs.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(counted)).alias("__c"))
    return made.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in new.items()])


def base_failed(config: RuleConfig = RuleConfig()) -> Column:
    return (F.col("n_words") < config.min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def metric_steps(config: RuleConfig = RuleConfig()) -> Column:
    """Array with the step of every metric: above cutoff i exactly if the step is above i."""

    def step(above: str, below: str, scale: int) -> Column:
        ratio = F.col(above) * scale / F.when(F.col(below) > 0, F.col(below))
        return F.coalesce(F.least(F.ceil(ratio), F.lit(config.steps)), F.lit(0)).cast("int")

    return F.array(*[step(a, b, s) for _, a, b, s in METRICS])


def most_allowed(n: Column, risk: float, error: float) -> Column:
    """The largest k for which k rejections in n good texts prove a rate of at most ``risk``:
    P(X <= k) <= error for X binomial(n, risk). -1 if not even k = 0 does. The tail is summed in
    logarithms, up to the mean, where it is about one half."""
    odds, log_none, level = math.log(risk / (1 - risk)), math.log1p(-risk), math.log(error)
    start = F.struct(
        (n * log_none).alias("p"), (n * log_none).alias("cdf"), F.when(n * log_none <= level, 0).otherwise(-1).alias("k")
    )

    def more(a: Column, i: Column) -> Column:
        p = a["p"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(p, a["cdf"])
        cdf = top + F.log1p(F.exp(F.least(p, a["cdf"]) - top))
        return F.struct(p.alias("p"), cdf.alias("cdf"), F.when(cdf <= level, i.cast("int")).otherwise(a["k"]).alias("k"))

    steps = F.when(F.floor(n * risk) >= 1, F.sequence(F.lit(1).cast("bigint"), F.floor(n * risk))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, more, lambda a: a["k"])


def cutoffs(counted: DataFrame, labels: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """One row per stratum (a language, or null for all others) with the array ``cuts``: the step
    above which a metric rejects, null where no cutoff is proven. At most 1 / min_share + 1 rows.

    ``labels`` (doc_id, quality) may repeat a document; one with both labels is not used.
    """
    good = (
        labels.groupBy("doc_id")
        .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
        .filter("lo = 1 AND hi = 1")
        .select("doc_id")
    )
    steps = counted.join(good, "doc_id").filter(~base_failed(config)).select("lang", metric_steps(config).alias("steps"))
    # Counts per language, metric and step: combined in the map tasks, small from there on.
    seen = stored(
        steps.select("lang", F.posexplode("steps").alias("metric", "step"))
        .groupBy("lang", "metric", "step")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sizes = seen.filter("metric = 0").groupBy("lang").agg(F.sum("n").alias("size"))
    total = sizes.agg(F.sum("size")).scalar()
    large = sizes.filter((F.col("size") >= F.lit(config.min_share) * total) & F.col("lang").isNotNull())
    large = stored(large.select("lang", F.lit(True).alias("large")))
    strata = F.when(F.col("large"), F.col("lang"))
    grouped = (
        seen.join(F.broadcast(large), "lang", "left")
        .groupBy(strata.alias("stratum"), "metric", "step")
        .agg(F.sum("n").alias("n"))
    )
    by_cut = W.partitionBy("stratum", "metric")
    tested = grouped.select(
        "stratum", "metric", F.col("step"),
        F.sum("n").over(by_cut).alias("good"),
        F.sum("n").over(by_cut.orderBy(F.desc("step"))).alias("from_step"),
        F.coalesce(F.lag("step").over(by_cut.orderBy("step")), F.lit(-1)).alias("below"),
    )
    share = config.error / len(METRICS) / (large.count() + 1)
    allowed = most_allowed(F.col("good"), config.risk / len(METRICS), share)
    # Texts of steps >= step are rejected by every cutoff from below on: the tightest is `below`,
    # as long as their number is allowed; if none is, the largest step itself rejects nothing.
    proven = tested.withColumn("allowed", allowed).withColumn("ok", F.col("from_step") <= F.col("allowed"))
    chosen = proven.groupBy("stratum", "metric").agg(
        F.min(F.when(F.col("ok"), F.col("below"))).alias("down"),
        F.max("step").alias("top"),
        F.max("allowed").alias("allowed"),
    )
    cut = F.when(F.col("allowed") >= 0, F.coalesce(F.col("down"), F.col("top")))
    return chosen.groupBy("stratum").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("metric", cut.alias("cut")))), lambda x: x["cut"]).alias("cuts")
    )


def judged(counted: DataFrame, cuts: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """Adds base_failed, the number of the first rejecting metric (null if none) and kept."""
    cuts = stored(cuts)
    named = F.broadcast(cuts.filter("stratum IS NOT NULL"))  # at most 1 / min_share rows
    others = cuts.filter("stratum IS NULL").select("cuts").scalar()
    met = counted.join(named, F.col("lang") == F.col("stratum"), "left").withColumn("__cuts", F.coalesce("cuts", others))
    above = F.zip_with(metric_steps(config), F.col("__cuts"), lambda s, c: F.coalesce(s > c, F.lit(False)))
    at = F.coalesce(F.array_position(above, True), F.lit(0))
    names = F.array(*[F.lit(m[0]) for m in METRICS])
    return met.select(
        *[F.col(f"`{c}`") for c in counted.columns],
        base_failed(config).alias("base_failed"),
        F.when(at > 0, F.element_at(names, at.cast("int"))).alias("rejected_by"),
    ).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def apply_rules(docs: DataFrame, labels: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """Counts, rules and verdict of every document. The text is read once; what is stored and
    joined are its counts. An empty table gives an empty one; without labels no rule rejects."""
    counted = stored(with_counts(docs.select("doc_id", "lang", "text")))
    return judged(counted, cutoffs(counted, labels, config), config)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"
    )


def _oracle(config: RuleConfig = RuleConfig()) -> str:
    gap, m, g = r"'[\x20\x09-\x0D]+'", len(METRICS), config.steps
    steps = "\n UNION ALL ".join(
        f"SELECT doc_id, lang, base_failed, {i} AS metric, coalesce(least(ceil({a} * {s} / nullif({b}, 0)), {g}), 0)::INT AS step FROM base"
        for i, (_, a, b, s) in enumerate(METRICS)
    )
    names = " ".join(f"WHEN {i} THEN '{x[0]}'" for i, x in enumerate(METRICS))
    p = config.risk / m
    return f"""
        WITH w AS (
            SELECT doc_id, lang, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), {gap}), lambda x: x <> '') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
            FROM documents
        ), windows AS (
            SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: i)) AS i, words FROM w WHERE len(words) >= 3
        ), counted AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM windows
        ), covered AS (
            SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM counted, (VALUES (0), (1), (2)) AS x(o) WHERE c >= 2 GROUP BY doc_id
        ), base AS (
            SELECT w.doc_id, lang, len(words)::BIGINT AS n_words,
                   length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
                   (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
                   (length(t) - length(translate(t, '{UPPER}', '')))::BIGINT AS n_upper,
                   (length(t) - length(translate(t, '!', '')))::BIGINT AS n_bangs,
                   len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                   coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                   (n_words < {config.min_words} OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AS base_failed
            FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id
        ), steps AS ({steps}),
        good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
        sizes AS (
            SELECT lang, count(*) AS size FROM base JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY lang
        ), large AS (
            SELECT lang FROM sizes WHERE size >= {config.min_share!r} * (SELECT sum(size) FROM sizes) AND lang IS NOT NULL
        ), labelled AS (
            SELECT CASE WHEN lang IN (SELECT lang FROM large) THEN lang END AS stratum, metric, step
            FROM steps JOIN good USING (doc_id) WHERE NOT base_failed
        ), strata AS (
            SELECT stratum, count(*) // {m} AS n FROM labelled GROUP BY stratum
        ), tails AS (
            SELECT stratum, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({p!r}) + (n - k) * ln(1 - {p!r})))
                       OVER (PARTITION BY stratum ORDER BY k) AS cdf
            FROM (SELECT stratum, n, unnest(range(0, greatest(1, floor(n * {p!r})::BIGINT + 1))) AS k FROM strata)
        ), allowed AS (
            SELECT stratum, max(k) AS allowed FROM tails
            WHERE cdf <= {config.error / m!r} / ((SELECT count(*) FROM large) + 1) GROUP BY stratum
        ), cuts AS (
            SELECT stratum, metric, min(cut) AS cut FROM (
                SELECT a.stratum, c.cut, l.metric, count(*) FILTER (l.step > c.cut) AS k, any_value(a.allowed) AS allowed
                FROM labelled l JOIN allowed a ON a.stratum IS NOT DISTINCT FROM l.stratum, (SELECT unnest(range(0, {g + 1})) AS cut) c
                GROUP BY ALL HAVING k <= any_value(a.allowed)
            ) GROUP BY ALL
        ), cut_of AS (
            SELECT s.doc_id, min(CASE WHEN s.step > c.cut THEN s.metric END) AS metric
            FROM steps s LEFT JOIN cuts c ON c.metric = s.metric
                 AND c.stratum IS NOT DISTINCT FROM (CASE WHEN s.lang IN (SELECT lang FROM large) THEN s.lang END)
            GROUP BY s.doc_id
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND metric IS NULL AS kept, CASE metric {names} END AS rejected_by
        FROM base JOIN cut_of USING (doc_id)"""


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {"op9_quality_rules": _oracle()}
