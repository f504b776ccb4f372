"""Scores and labels as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions.text import any_of


def star_label(star: Column, cfg: C.LabelConfig = C.LabelConfig()) -> Column:
    """1 for a good review, 0 for a bad one, -1 for a neutral one."""
    return F.when(star >= cfg.positive_min, 1).when(star <= cfg.negative_max, 0).otherwise(-1)


def _hits(text: Column, words, whole_words: bool) -> Column:
    if not words:
        return F.lit(0)
    if whole_words:
        # Most characters begin no word: a look at the next one costs less than one behind.
        first = "" if "" in words else f"(?=[{''.join(sorted({re.escape(w[0]) for w in words}))}])"
        pattern = f"{first}(?<![a-z])(?:{any_of(words)})(?![a-z])"
        return F.regexp_count(F.lower(text), F.lit(pattern))
    ordered = sorted(words, key=len, reverse=True)
    return F.regexp_count(text, F.lit(any_of(ordered)))


def lexicon_counts(text: Column, lexicon: C.SentimentLexicon) -> tuple[Column, Column]:
    return (
        _hits(text, lexicon.positive, lexicon.whole_words),
        _hits(text, lexicon.negative, lexicon.whole_words),
    )


def lexicon_p_pos(text: Column, lexicon: C.SentimentLexicon) -> Column:
    """Smoothed share of positive words among the sentiment words."""
    pos, neg = lexicon_counts(text, lexicon)
    return (pos + F.lit(1.0)) / (pos + neg + F.lit(2.0))


def pair_softmax(positive: Column, negative: Column) -> Column:
    """P(positive) from the logits of the two sentiment classes."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(negative - positive))


def verdict(p_pos: Column, threshold) -> Column:
    return F.when(p_pos >= threshold, 1).otherwise(0)


def binomial_ratings(p_pos: Column) -> Column:
    """Distribution over the ratings 1..5 spread around ``1 + 4 p``; the word-list scorer's
    stand-in for a trained rating head."""
    q = F.lit(1.0) - p_pos
    return F.array(
        q * q * q * q,
        F.lit(4.0) * p_pos * q * q * q,
        F.lit(6.0) * p_pos * p_pos * q * q,
        F.lit(4.0) * p_pos * p_pos * p_pos * q,
        p_pos * p_pos * p_pos * p_pos,
    )


def expected_rating(dist: Column) -> Column:
    weighted = F.transform(dist, lambda p, i: p * (i + F.lit(1)))
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)


def best_rating(dist: Column) -> Column:
    """Most likely rating; the lowest one on a tie."""
    return F.array_position(dist, F.array_max(dist)).cast("int")


def best_rating_p(dist: Column) -> Column:
    return F.array_max(dist)


def like_weight(likes: Column) -> Column:
    return F.lit(1.0) + F.log1p(F.greatest(F.lit(0), likes).cast("double"))


def spread_hash(row_id: Column, seed: int = 0) -> Column:
    """Multiplicative hash of ``row_id + seed`` to 0 .. 2^32-1. The sum is first reduced below
    2^31, so the product always fits a BIGINT."""
    small = F.pmod(F.pmod(row_id, F.lit(1 << 31)) + F.lit(seed), F.lit(1 << 31))
    return F.pmod(small * F.lit(C.HASH_MULTIPLIER), F.lit(1 << 32))


def split_bucket(row_id: Column, buckets: int = 1000) -> Column:
    """``(row_id * multiplier) mod buckets``; both factors are reduced first, so no id overflows."""
    return F.pmod(
        F.pmod(row_id, F.lit(buckets)) * F.lit(C.HASH_MULTIPLIER % buckets), F.lit(buckets)
    ).cast("int")


def split_name(row_id: Column, cfg: C.SplitConfig = C.SplitConfig()) -> Column:
    bucket = split_bucket(row_id, cfg.buckets)
    return (
        F.when(bucket < cfg.val_below, "val").when(bucket < cfg.train_below, "train").otherwise("rest")
    )
