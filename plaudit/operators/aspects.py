"""Aspect mining: clauses, aspect sentiment, evidence, pros and cons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions.scoring import like_weight
from plaudit.functions.text import clauses, hit_clauses
from plaudit.operators.scale import attach_group_values, stable_copy, top_per_group

Scorer = Callable[[Column], Column]
#: Groups of mentions above this size are cut to their strongest ones before they are ranked.
LARGE_GROUP = 1000


def clause_rows(reviews: DataFrame, cfg: C.AspectConfig = C.AspectConfig()) -> DataFrame:
    """One row per clause of a review."""
    parts = clauses(F.col("comment"), cfg.clause_pattern, cfg.min_clause_chars)
    return reviews.select("row_id", F.posexplode(parts).alias("pos", "clause"))


def aspect_mentions(reviews: DataFrame, score: Scorer, cfg: C.AspectConfig = C.AspectConfig()) -> DataFrame:
    """One row per (review, clause, aspect) with the clause score ``p``.

    ``reviews`` is the sample to mine. A clause is scored once, before its aspects fan out.
    """
    hits = reviews.select("row_id", "item", "likes", F.posexplode(hit_clauses(F.col("comment"), cfg)).alias("pos", "hit"))
    scored = hits.select(
        "row_id", "item", "likes", "pos", "hit.clause", "hit.aspects",
        score(F.col("hit.clause")).alias("p"),
    )
    return scored.select(
        "row_id", "item", "likes", "pos", "clause", "p", F.explode("aspects").alias("aspect")
    )


def aspect_rates(mentions: DataFrame) -> DataFrame:
    """Mentions, mean score and like-weighted mean score per item and aspect."""
    w = like_weight(F.col("likes"))
    return mentions.groupBy("item", "aspect").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.avg("p").alias("pos_rate"),
        (F.sum(w * F.col("p")) / F.sum(w)).alias("like_weighted_pos_rate"),
    )


def aspect_evidence(mentions: DataFrame, cfg: C.AspectConfig = C.AspectConfig()) -> DataFrame:
    """Strongest clauses per item, aspect and polarity. ``mentions`` is read twice; store it if it
    is not a table."""
    strength = 2 * F.abs(F.col("p") - 0.5) * like_weight(F.col("likes"))
    polar = mentions.withColumn(
        "polarity", F.when(F.col("p") >= 0.5, "pos").otherwise("neg")
    ).withColumn("strength", strength)
    order = [F.desc("strength"), F.asc("clause"), F.asc("row_id")]
    group = ["item", "aspect", "polarity"]
    top = top_per_group(_strongest(polar, group, cfg.evidence), group, order, cfg.evidence)
    return top.select(
        "item", "aspect", "polarity", "rank", "clause", "p", "likes", "strength", "row_id"
    )


def _strongest(polar: DataFrame, group: list[str], k: int) -> DataFrame:
    """Without what is weaker than the ``k`` largest strengths of a large group, so that few clauses
    are sorted. The strengths are found in rows without text."""
    counts = polar.groupBy(*group, "strength").agg(F.count(F.lit(1)).alias("__n"))
    sizes = counts.groupBy(*group).agg(F.sum("__n").alias("__rows")).filter(F.col("__rows") > LARGE_GROUP)
    best = top_per_group(counts, group, [F.desc("strength")], k, "__at")
    cuts = best.groupBy(*group).agg(F.min("strength").alias("__cut")).join(sizes, group)
    strong = attach_group_values(
        polar, cuts, group, "__rows", ["row_id"],
        keep=lambda g: ~F.coalesce(F.col("strength") < g["__cut"], F.lit(False)),
    )
    return strong.select(*polar.columns)


def aspect_table(mentions: DataFrame, cfg: C.AspectConfig = C.AspectConfig()) -> DataFrame:
    """Rates with both evidence lists; the number of rows is items x aspects."""
    evidence = aspect_evidence(mentions, cfg)
    entry = F.struct("rank", "clause", "p", "likes")

    def pick(polarity: str) -> Column:
        chosen = F.array_sort(F.collect_list(F.when(F.col("polarity") == polarity, entry)))
        return F.transform(chosen, lambda e: F.struct(e["clause"], e["p"].alias("p_pos"), e["likes"]))

    lists = evidence.groupBy("item", "aspect").agg(
        pick("pos").alias("evidence_pos"), pick("neg").alias("evidence_neg")
    )
    return aspect_rates(mentions).join(lists, ["item", "aspect"], "left")


def aspects_by_item(table: DataFrame, sampled: DataFrame) -> DataFrame:
    """Nested form: one row per item with its aspects by mentions and its sample size."""
    sizes = sampled.groupBy("item").agg(F.count(F.lit(1)).alias("n_sampled"))
    row = F.struct(
        (-F.col("mentions")).alias("__order"), "aspect", "mentions", "pos_rate",
        "like_weighted_pos_rate", "evidence_pos", "evidence_neg",
    )
    nested = table.groupBy("item").agg(F.array_sort(F.collect_list(row)).alias("aspects"))
    bare = F.transform("aspects", lambda a: a.dropFields("__order"))
    return sizes.join(nested.withColumn("aspects", bare), "item", "inner")


def qualified(rates: DataFrame, cfg: C.AspectConfig = C.AspectConfig()) -> DataFrame:
    return rates.filter(F.col("mentions") >= cfg.min_mentions)


def pros(rates: DataFrame, cfg: C.AspectConfig = C.AspectConfig()) -> DataFrame:
    gain = F.col("mentions") * (F.col("pos_rate") - cfg.positive_rate)
    good = qualified(rates, cfg).filter(F.col("pos_rate") >= cfg.positive_rate)
    ranked = good.withColumn("gain", gain)
    return top_per_group(ranked, ["item"], [F.desc("gain"), F.asc("aspect")], cfg.top_aspects)


def cons(rates: DataFrame, cfg: C.AspectConfig = C.AspectConfig()) -> DataFrame:
    gain = F.col("mentions") * (cfg.negative_rate - F.col("pos_rate"))
    bad = qualified(rates, cfg).filter(F.col("pos_rate") <= cfg.negative_rate)
    ranked = bad.withColumn("gain", gain)
    return top_per_group(ranked, ["item"], [F.desc("gain"), F.asc("aspect")], cfg.top_aspects)


def weak_points(rates: DataFrame, cfg: C.AspectConfig = C.AspectConfig()) -> DataFrame:
    """Lowest-rated aspects of the items that have no con. The rates, a few rows an item, are
    stored: they are read twice, and reading the reviews twice for them costs as much again."""
    enough = stable_copy(qualified(rates, cfg))
    with_cons = enough.filter(F.col("pos_rate") <= cfg.negative_rate).select("item").distinct()
    rest = enough.join(with_cons, "item", "left_anti")
    return top_per_group(rest, ["item"], [F.asc("pos_rate"), F.asc("aspect")], cfg.weak_aspects)


def pros_and_cons(table: DataFrame, sampled: DataFrame, keywords: DataFrame | None = None,
                  cfg: C.AspectConfig = C.AspectConfig()) -> DataFrame:
    """One row per mined item: pros, cons and weak as arrays of structs, keyword lists."""
    sizes = sampled.groupBy("item").agg(F.count(F.lit(1)).alias("n_sampled"))
    return pros_and_cons_of(table, sizes, keywords, cfg)


def pros_and_cons_of(table: DataFrame, sizes: DataFrame, keywords: DataFrame | None = None,
                     cfg: C.AspectConfig = C.AspectConfig()) -> DataFrame:
    """The same for given numbers of reviews (item, n_sampled)."""

    def listed(rows: DataFrame, evidence: str, name: str) -> DataFrame:
        shown = F.slice(F.transform(evidence, lambda e: e["clause"]), 1, cfg.evidence_shown)
        entry = F.struct("rank", "aspect", "mentions", "pos_rate", shown.alias("evidence"))
        packed = rows.groupBy("item").agg(F.array_sort(F.collect_list(entry)).alias(name))
        return packed.withColumn(name, F.transform(name, lambda e: e.dropFields("rank")))

    out = table.select("item").distinct().join(sizes, "item", "inner")
    parts = {
        "pros": listed(pros(table, cfg), "evidence_pos", "pros"),
        "cons": listed(cons(table, cfg), "evidence_neg", "cons"),
        "weak": listed(weak_points(table, cfg), "evidence_neg", "weak"),
    }
    for name, part in parts.items():
        empty = F.array().cast(part.schema[name].dataType)
        out = out.join(part, "item", "left").withColumn(name, F.coalesce(F.col(name), empty))
    if keywords is not None:
        out = out.join(keywords, "item", "left")
    return out
