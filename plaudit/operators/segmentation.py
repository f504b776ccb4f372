"""Words of text without spaces: a dictionary mined from the corpus, and the best path through it.

A string of ideographs is a word if its parts occur together far more often than by chance
(point-wise mutual information over every way to cut it in two) and if it occurs in many
surroundings (entropy of the characters before and after it). All statistics come from one table
of n-gram counts, so the texts are read once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions.text import letter_runs
from plaudit.operators.scale import bounded_batches, stable_copy

#: Weights are logarithms in millionths, as whole numbers: sums are exact and ties are real ones.
WEIGHT_SCALE = 1_000_000
HAN_RUN = "[一-龥]+"


def gram_counts(reviews: DataFrame, cfg: C.SegmentConfig = C.SegmentConfig(), text: Column | None = None) -> DataFrame:
    """``gram, n``: how often every string of up to ``max_chars`` + 1 ideographs occurs in a run.
    Runs are counted first, so a run that repeats is cut into strings once."""
    text = F.col("comment") if text is None else text
    runs = F.regexp_extract_all(text, F.lit(HAN_RUN), F.lit(0))
    rows = reviews.select(F.explode(runs).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("times"))

    def starts(size: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.length("run") - (size - 1)), lambda i: F.substring("run", i, F.lit(size)))
        return F.when(F.length("run") >= size, made).otherwise(F.array().cast("array<string>"))

    grams = rows.select("times", F.explode(F.concat(*[starts(k + 1) for k in range(cfg.max_chars + 1)])).alias("gram"))
    return grams.groupBy("gram").agg(F.sum("times").alias("n"))


def word_statistics(counts: DataFrame, cfg: C.SegmentConfig = C.SegmentConfig()) -> DataFrame:
    """``word, n, pmi, left_entropy, right_entropy`` of all strings of two to ``max_chars``
    characters that occur ``min_count`` times.

    ``counts`` (see ``gram_counts``) should be stored. The neighbours of a string are the strings
    one character longer; an end of a run is a neighbour of its own every time. A string with a
    frequent part is frequent itself only if the part is, so the joins carry frequent strings alone.
    """
    size = F.length("gram")
    often = counts.filter(F.col("n") >= cfg.min_count)
    words = often.filter(size.between(2, cfg.max_chars)).select(F.col("gram").alias("word"), "n")

    def entropy(shorter: Column, name: str) -> DataFrame:
        sums = counts.filter(size > 2).groupBy(shorter.alias("word")).agg(F.sum(F.col("n") * F.ln("n")).alias("s"))
        return words.join(sums, "word", "left").select(
            "word", F.greatest(F.lit(0.0), F.ln("n") - F.coalesce("s", F.lit(0.0)) / F.col("n")).alias(name)
        )

    total = counts.filter(size == 1).agg(F.sum("n").cast("double").alias("t")).scalar()
    cuts = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    halves = cuts.select(
        "word", "n", F.substring("word", F.lit(1), F.col("at")).alias("head"),
        F.substring("word", F.col("at") + 1, F.length("word")).alias("tail"),
    )
    part = often.select(F.col("gram"), F.col("n").alias("c"))
    met = halves.join(part.withColumnsRenamed({"gram": "head", "c": "n_head"}), "head")
    met = met.join(part.withColumnsRenamed({"gram": "tail", "c": "n_tail"}), "tail")
    chance = F.ln("n") + F.ln(total) - F.ln("n_head") - F.ln("n_tail")
    pmi = met.groupBy("word").agg(F.min(chance).alias("pmi"))
    without_last = F.substring("gram", F.lit(1), size - 1)
    without_first = F.substring("gram", F.lit(2), size - 1)
    parts = [words, pmi, entropy(without_first, "left_entropy"), entropy(without_last, "right_entropy")]
    return reduce(lambda a, b: a.join(b, "word"), parts)


def mine_dictionary(reviews: DataFrame, cfg: C.SegmentConfig = C.SegmentConfig(), text: Column | None = None) -> DataFrame:
    """``word, n, weight``: the words that pass all bounds, and every character of the corpus.
    The weight is the logarithm of the share of all characters, in millionths. Of more than
    ``max_words`` words the most frequent stay, ties by the word."""
    counts = stable_copy(gram_counts(reviews, cfg, text))
    stats = word_statistics(counts, cfg)
    bounds = (F.col("pmi") >= cfg.min_pmi) & (F.least("left_entropy", "right_entropy") >= cfg.min_entropy)
    words = stats.filter(bounds).orderBy(F.desc("n"), "word").limit(cfg.max_words).select("word", "n")
    single = counts.filter(F.length("gram") == 1).select(F.col("gram").alias("word"), "n")
    total = counts.filter(F.length("gram") == 1).agg(F.sum("n").cast("double").alias("t")).scalar()
    weight = F.round(WEIGHT_SCALE * F.ln(F.col("n") / total)).cast("bigint")
    return words.unionByName(single).select("word", "n", weight.alias("weight"))


def best_path(run: str, weights: dict[str, int], longest: int, unseen: int) -> list[str]:
    """The cut of a run with the greatest sum of weights, from the end to the start (Viterbi).
    Of equal sums the one of fewer words, then the one whose first word is longer."""
    n = len(run)
    best: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)  # sum, minus words, length of the first
    for i in range(n - 1, -1, -1):
        found = None
        for size in range(1, min(longest, n - i) + 1):
            weight = weights.get(run[i : i + size], unseen if size == 1 else None)
            if weight is None:
                continue
            total, words, _ = best[i + size]
            way = (total + weight, words - 1, size)
            if found is None or way > found:
                found = way
        best[i] = found
    out, i = [], 0
    while i < n:
        out.append(run[i : i + best[i][2]])
        i += best[i][2]
    return out


def segmenter(dictionary: DataFrame) -> Callable[[Column], Column]:
    """A tokenizer over the dictionary (word, weight): runs of ideographs are cut into words, every
    character being in exactly one; other runs of letters are words as they stand.

    The dictionary is bounded by its ``max_words`` and goes to every task once. Only the runs of
    ideographs of a text reach Python, in batches bounded by bytes; a text without them costs an
    empty list.
    """
    spark = dictionary.sparkSession
    bounded_batches(spark)
    rows = dictionary.select("word", "weight").toArrow()
    weights = dict(zip(rows.column("word").to_pylist(), rows.column("weight").to_pylist()))
    if not weights:
        return letter_runs
    longest = max(map(len, weights))
    unseen = min(weights.values()) - WEIGHT_SCALE
    held = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("array<array<string>>")
    def cut(runs: pa.Array) -> pa.Array:
        """Every distinct run of a batch is cut once; the rest is Arrow, without an object per run."""
        known, flat = held.value, runs.flatten().dictionary_encode()
        words = [best_path(r, known, longest, unseen) for r in flat.dictionary.to_pylist()]
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(runs).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.list_(pa.string())).take(flat.indices))

    def tokenize(text: Column) -> Column:
        runs = F.coalesce(letter_runs(text), F.array().cast("array<string>"))
        han = F.filter(runs, lambda r: r.rlike("^[一-龥]"))
        other = F.filter(runs, lambda r: ~r.rlike("^[一-龥]"))
        return F.concat(other, F.flatten(cut(han)))

    return tokenize


def corpus_tokenizer(reviews: DataFrame, cfg: C.SegmentConfig = C.SegmentConfig()) -> Callable[[Column], Column]:
    """The segmenter over the words that the reviews themselves show."""
    return segmenter(mine_dictionary(reviews, cfg))
