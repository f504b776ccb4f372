"""Packing into length buckets that minimise padding, and token-budget batches inside them.

Texts longer than the model length are cut into consecutive pieces, so the histogram of lengths
has at most ``max_length`` rows, whatever the corpus. Dynamic programming over the histogram gives
the bucket boundaries with the least padding. Inside a bucket the pieces are numbered in parts,
and a batch takes as many as the token budget holds at the bucket's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit.llm.common import stored, table, text_of, word_array, word_count


@dataclass(frozen=True)
class PackConfig:
    """``budget`` is the number of tokens of a batch, padding included; at least ``max_length``.
    ``part_pieces``: about how many pieces are numbered in one task."""

    max_length: int = 2048
    buckets: int = 16
    budget: int = 65_536
    seed: int = 1
    part_pieces: int = 50_000

    def __post_init__(self):
        if not 1 <= self.max_length <= self.budget or self.buckets < 1:
            raise ValueError("1 <= max_length <= budget and buckets >= 1 are required")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds that minimise the padding of ``counts`` pieces of
    ``lengths`` (distinct, ascending), found by dynamic programming: the cheapest way to cover
    the first j lengths with k buckets ends with a bucket i+1..j, each padded to length j.
    Of equally good solutions the one with fewer buckets is taken.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(counts.astype(np.float64))])
    used = np.concatenate([[0], np.cumsum(counts.astype(np.float64) * lengths)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    choice, bounds = [], []
    upper = np.arange(n)
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            i = upper[:j]
            cost = best[i] + lengths[j - 1] * (rows[j] - rows[i]) - (used[j] - used[i])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        choice.append((cut, new[n]))
        best = new
        if new[n] == 0:
            break
    k = int(np.argmin([c for _, c in choice]))
    j = n
    while j > 0:
        bounds.append(int(lengths[j - 1]))
        j = int(choice[k][0][j])
        k -= 1
    return bounds[::-1]


def pieces(docs: DataFrame, n_tokens: Column, config: PackConfig = PackConfig()) -> DataFrame:
    """``doc_id, th, piece, first, n_tokens``: consecutive pieces of at most ``max_length``
    tokens that together hold every token. A document without tokens has no piece."""
    sized = docs.select("doc_id", F.xxhash64(text_of()).alias("th"), n_tokens.alias("total")).filter("total > 0")
    last = ((F.col("total") - 1) / config.max_length).cast("bigint")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    first = F.col("piece") * config.max_length
    return cut.select(
        "doc_id", "th", "piece", first.alias("first"), F.least(F.lit(config.max_length), F.col("total") - first).cast("int").alias("n_tokens")
    )


def pack(docs: DataFrame, n_tokens: Column | None = None, config: PackConfig = PackConfig()) -> DataFrame:
    """The batch plan: a row per piece with ``bucket`` (0 is the shortest), ``bucket_length``,
    ``batch``, ``slot`` and ``padding`` beside the columns of
    ``pieces``; ``text_hash`` (xxhash64) tells the texts of one id apart.

    ``n_tokens`` defaults to the words of the text (null: none). Batches of a bucket are full but
    for the last. The order inside a bucket is drawn by hash, so reruns agree; repeated rows are
    pieces of their own, in any order among themselves. An empty table gives an empty plan.
    """
    n_tokens = word_count(text_of()) if n_tokens is None else n_tokens
    rows = stored(pieces(docs, n_tokens, config))
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toPandas()  # at most max_length rows
    bounds = best_boundaries(histogram["n_tokens"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), config.buckets)
    if not bounds:
        bounds = [config.max_length]
    array = F.array(*[F.lit(b) for b in bounds])
    bucket = F.size(F.filter(array, lambda b: b < F.col("n_tokens")))
    parts = int(max(1, -(-int(histogram["n"].sum()) // config.part_pieces)))
    mix = F.xxhash64("doc_id", "th", "piece", F.lit(config.seed))
    dealt = rows.withColumns({"bucket": bucket, "mix": mix}).withColumn("part", F.pmod(F.col("mix"), F.lit(parts)))
    totals = dealt.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("bucket", "part").orderBy("mix", "doc_id", "th", "piece")
    numbered = dealt.withColumn("local", F.row_number().over(inside) - 1).join(offsets, ["bucket", "part"])
    index = F.col("local") + F.col("offset")
    length = F.element_at(array, F.col("bucket") + 1)
    fit = F.floor(F.lit(config.budget) / length)
    return numbered.select(
        "doc_id", F.col("th").alias("text_hash"), "piece", "first", "n_tokens", "bucket", length.alias("bucket_length"), F.floor(index / fit).alias("batch"),
        (index % fit).cast("int").alias("slot"), (length - F.col("n_tokens")).alias("padding"),
    )


def padded_batches(docs: DataFrame, plan: DataFrame, config: PackConfig = PackConfig(), pad: str = "") -> DataFrame:
    """The batches of a plan with their words: a row per piece (bucket, batch, slot, words padded
    to the bucket's length). A batch is bounded by the token budget, so a task may gather it."""
    words = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("th"), word_array(text_of()).alias("words"))
    words = words.dropDuplicates(["id", "th"])
    met = plan.join(words, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")))
    piece = F.slice("words", (F.col("first") + 1).cast("int"), F.col("n_tokens"))
    filled = F.concat(piece, F.array_repeat(F.lit(pad), F.col("padding").cast("int")))
    return met.select("bucket", "batch", "slot", "doc_id", "piece", filled.alias("words"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
