"""Mixing sources to target weights by blocks of words.

The documents of a source, in an order drawn from their hashes, are one long stream of words, cut
into blocks of fixed length. Every output shard draws how many of its slots go to each source; the
slots of a source count up through all shards, and pseudorandom permutations (one per pass over the
source) map them to blocks. Slots and blocks meet by index. Streams are numbered in parts, so that
a source may hold any share of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit.llm.common import bounded_batches, map_columns, stored, table, text_of, word_count



@dataclass(frozen=True)
class MixConfig:
    """Weights repeat over the sources in code-point order. ``cap`` bounds how often a word is
    taken. ``part_docs`` is how many documents, about, are numbered in one task, and ``task_slots``
    how many slots, about, one task makes at most."""

    weights: tuple[int, ...] = (1, 2, 3)
    cap: int = 3
    block: int = 256
    slots: int = 4096
    seed: int = 8
    part_docs: int = 5_000
    task_slots: int = 4_000_000


def source_targets(sizes: pd.DataFrame, config: MixConfig = MixConfig()) -> pd.DataFrame:
    """Targets of sources (source, size): shares of the whole size by weight, none above ``cap``
    times its own size; the excess is shared again by weight among the others."""
    names = sizes["source"].tolist()
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, (names[i] or "").encode("utf-8")))
    out = sizes.iloc[order].reset_index(drop=True)
    size = out["size"].to_numpy(float)
    weight = np.resize(np.array(config.weights, float), len(out))
    target, limit, free = np.zeros(len(out)), config.cap * size, np.ones(len(out), bool)
    left = size.sum()
    while free.any():
        share = left * weight / weight[free].sum()
        over = free & (share > limit)
        if not over.any():
            target[free] = share[free]
            break
        target[over] = limit[over]
        left -= limit[over].sum()
        free &= ~over
    return out.assign(target=target, weight=weight)


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """64-bit finaliser, as the round function of the permutation."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given places: four Feistel rounds on the
    smallest even number of bits, walking the cycle until the value is below n."""
    half = max(1, (max(1, int(n - 1).bit_length()) + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = out[todo] >> np.uint64(half), out[todo] & low
            for r in range(4):
                left, right = right, left ^ (_mixed(right, (key * 4 + r) & 0xFFFFFFFFFFFF) & low)
            out[todo] = (left << np.uint64(half)) | right
            todo &= out >= np.uint64(n)
    return out.astype(np.int64)


def streams(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """Place of every document in the stream of its source: the columns doc_id, source, size,
    th (hash of the text, which tells repeated ids apart), start. Stored.

    Documents are dealt into parts of their source by hash; each part adds up its own documents,
    and the parts before it are added from a small table. Rows alike in all of these columns are
    interchangeable. Words are counted in the scan; the text is not shuffled.
    """
    t = text_of()
    sized = stored(docs.select("doc_id", "source", F.xxhash64(t).alias("th"), word_count(t).alias("size")))
    counts = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.sum("n") / config.part_docs)).alias("parts")
    number = counts.agg(parts).first()[0]
    mix = F.xxhash64(F.col("doc_id"), F.col("th"), F.lit(config.seed))
    dealt = sized.withColumn("mix", mix).withColumn("part", F.pmod(F.col("mix"), F.lit(number)))
    totals = dealt.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset")
    )
    inside = W.partitionBy("source", "part").orderBy("mix", "doc_id", "th").rowsBetween(W.unboundedPreceding, -1)
    local = dealt.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = local.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return stored(placed.select("doc_id", "source", "th", "size", (F.col("local") + F.col("offset")).alias("start")))


def block_takes(spark, targets: pd.DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """``no, block, shard, slot`` of every slot of the mix, where ``no`` is the row of the source
    in ``targets``.

    Each shard gives every source the whole part of its expected slots and draws the rest from a
    multinomial. Slots beyond ``cap`` passes over a source would take a word too often: they stay
    empty (a few at most, as only sources with a target at the cap come near).
    """
    live = targets[(targets["size"] > 0) & (targets["target"] > 0)]
    if not len(live):
        return spark.createDataFrame([], "no int, block long, shard long, slot long")
    no = live.index.to_numpy(np.int64)
    blocks = -(-live["size"].to_numpy(np.int64) // config.block)
    wanted = live["target"].to_numpy(float) / live["size"].to_numpy(float) * blocks  # expected slots
    total, slots = int(round(wanted.sum())), config.slots
    shards, p, seed = -(-total // slots), wanted / wanted.sum(), config.seed

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                size = min(slots, total - int(shard) * slots)
                whole = np.floor(size * p)
                rest = size * p - whole
                n = int(size - whole.sum())
                drawn = np.random.default_rng([seed, int(shard)]).multinomial(n, rest / rest.sum()) if n else 0
                yield pd.DataFrame({"no": no, "shard": int(shard), "n": (whole + drawn).astype(np.int64)})

    shard_rows = spark.range(shards).repartition(max(1, min(shards, spark.sparkContext.defaultParallelism * 4)))
    drawn = stored(shard_rows.mapInPandas(draw, "no long, shard long, n long"))
    before = W.partitionBy("no").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    counted = drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("n > 0")
    at, cap = {int(k): i for i, k in enumerate(no)}, config.cap

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, shard, n, first in zip(batch["no"], batch["shard"], batch["n"], batch["first"]):
                size = int(blocks[at[int(source)]])
                index = np.arange(first, min(first + n, cap * size), dtype=np.int64)
                for turn in np.unique(index // size):
                    mine = index[index // size == turn]
                    block = permuted(mine % size, size, int(seed * 1_000_003 + source * 101 + turn))
                    yield pd.DataFrame({"no": int(source), "block": block, "shard": int(shard), "slot": mine})

    # The draws of one source lie in one task of the window; they are dealt again by shard, so that
    # its slots come from many tasks. The number is given, as Spark would join such small parts.
    tasks = max(min(shards * len(no), spark.sparkContext.defaultParallelism * 4), -(-total // config.task_slots))
    return counted.repartition(tasks, "no", "shard").mapInPandas(place, "no int, block long, shard long, slot long")


def mix_plan(docs: DataFrame, config: MixConfig = MixConfig()) -> tuple[DataFrame, DataFrame, pd.DataFrame]:
    """The streams, the pieces of documents in the mix and the targets.

    A piece (doc_id, th, size, start, block, shard, slot, first, words) is the part of a document
    in a taken block: ``words`` words from the document's word ``first`` on. Documents alike in
    id, text and start share their pieces. A null text or one without words has none. The sizes
    of the sources come to the driver: a dimension table, one row per source.
    """
    placed = streams(docs, config)
    sizes = placed.groupBy("source").agg(F.sum("size").alias("size"))
    targets = source_targets(sizes.toPandas(), config)
    spark = docs.sparkSession
    named = spark.createDataFrame(
        [(i, s) for i, s in enumerate(targets["source"])], "no int, source string"
    )
    # The sources are at the driver already, one row each; they may be broadcast. The slots grow
    # with the corpus, but Spark takes them for as small as the draws they come from.
    named = F.broadcast(named)
    rows = placed.filter("size > 0").join(named, placed["source"].eqNullSafe(named["source"])).drop("source")
    covered = F.sequence((F.col("start") / config.block).cast("bigint"), ((F.col("start") + F.col("size") - 1) / config.block).cast("bigint"))
    spans = rows.withColumn("block", F.explode(covered))
    taken = block_takes(spark, targets, config)
    met = spans.join(taken.hint("merge"), ["no", "block"])
    begin = F.greatest(F.col("start"), F.col("block") * config.block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * config.block)
    pieces = met.select(
        "doc_id", "th", "size", "start", "block", "shard", "slot", (begin - F.col("start")).alias("first"), (end - begin).alias("words")
    )
    return placed, pieces, targets


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    placed, pieces, targets = mix_plan(docs)
    per_doc = pieces.groupBy("doc_id", "th", "start").agg(F.sum("words").alias("taken"))
    named = spark.createDataFrame(
        [(s, int(n), float(t)) for s, n, t in zip(targets["source"], targets["size"], targets["target"])],
        "s string, source_size long, target double",
    )
    keys = [placed[k].eqNullSafe(per_doc[k]) for k in ("doc_id", "th", "start")]
    counted = placed.join(per_doc, keys, "left").select(placed["*"], F.coalesce("taken", F.lit(0)).alias("taken"))
    return counted.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per piece, whose ``text`` is the
    piece as it stands in the document (``n_chars``, if there, is its length). Pieces that follow
    each other in a document join without loss; a piece taken twice gives two rows.
    """
    bounded_batches(docs.sparkSession)
    placed, pieces, _ = mix_plan(docs, config)
    listed = F.collect_list(F.struct("first", "words", "shard", "slot")).alias("__pieces")
    per_doc = pieces.groupBy(F.col("doc_id").alias("__of"), F.col("th").alias("__of_th")).agg(listed)
    text = docs.withColumn("__th", F.xxhash64(text_of()))
    if not placed.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
        text = text.dropDuplicates(["doc_id", "__th"])  # their pieces are in one list
    met = text.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__of")) & (F.col("__th") == F.col("__of_th")))
    rows = met.select(*docs.columns, "__pieces")
    sized = "n_chars" in docs.columns

    def cut(batch: pa.RecordBatch) -> tuple[list, dict[str, list]]:
        take, out = [], []
        for i, (text, pieces) in enumerate(zip(batch.column("text").to_pylist(), batch.column("__pieces").to_pylist())):
            starts = word_starts(text)
            for p in sorted(pieces, key=lambda p: (p["shard"], p["slot"], p["first"])):
                a, b = p["first"], p["first"] + p["words"]
                take.append(i)
                out.append(text[0 if a == 0 else starts[a] : starts[b] if b < len(starts) else None])
        return take, {"text": out} | ({"n_chars": [len(x) for x in out]} if sized else {})

    new = {"text": "string"} | ({"n_chars": docs.schema["n_chars"].dataType.simpleString()} if sized else {})
    return map_columns(rows, cut, new, drop=("__pieces",))


def word_starts(text: str) -> list[int]:
    """Where the words begin, in code points."""
    return [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
