"""Character vocabulary and sequence encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions.scoring import star_label
from plaudit.functions.text import characters


def forced_tokens(cfg: C.SequenceConfig = C.SequenceConfig()) -> list[str]:
    """Specials, then every character of the template and of the labels, first come first."""
    chars = cfg.prefix + cfg.mid + cfg.sep + C.POSITIVE_CHAR + C.NEGATIVE_CHAR + C.RATING_CHARS
    return list(dict.fromkeys([*C.SPECIAL_TOKENS, *chars]))


def char_counts(texts: DataFrame, text: str = "comment") -> DataFrame:
    chars = texts.select(F.explode(characters(F.col(text))).alias("token"))
    return chars.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def build_vocab(texts: DataFrame, cfg: C.SequenceConfig = C.SequenceConfig(),
                text: str = "comment") -> DataFrame:
    """(id, token, freq): forced tokens first, then characters by count, capped in size.

    At most ``vocab_size`` rows pass the limit, so numbering them is a small window.
    """
    forced = forced_tokens(cfg)
    spark = texts.sparkSession
    head = spark.createDataFrame(
        list(enumerate(forced)), "id bigint, token string"
    ).withColumn("freq", F.lit(None).cast("bigint"))
    counted = (
        char_counts(texts, text)
        .filter((F.col("freq") >= cfg.min_freq) & ~F.col("token").isin(*forced))
        .orderBy(F.desc("freq"), "token")
        .limit(max(0, cfg.vocab_size - len(forced)))
    )
    rank = F.row_number().over(W.orderBy(F.desc("freq"), "token"))
    tail = counted.select(
        (rank - 1 + len(forced)).cast("bigint").alias("id"), "token", "freq"
    )
    return head.unionByName(tail)


def code_point_index(vocab: DataFrame) -> Column:
    """Scalar array: position = code point, value = token id (unknown where there is none).

    An array gives every character its id in constant time, where a map would be searched
    from its start. Code points end at 0x10FFFF, which bounds the array; it is built once.
    """
    single = vocab.filter(F.length("token") == 1).select(F.ascii("token").alias("cp"), "id")
    top = single.agg(F.max("cp").alias("top")).scalar()
    slots = vocab.sparkSession.range(0x110000).filter(F.col("id") <= top).withColumnRenamed("id", "slot")
    ids = slots.join(F.broadcast(single), F.col("slot") == F.col("cp"), "left").select(
        "slot", F.coalesce(F.col("id"), F.lit(C.UNK_ID)).cast("int").alias("id")
    )
    packed = ids.agg(F.array_sort(F.collect_list(F.struct("slot", "id"))).alias("a"))
    return packed.select(F.transform("a", lambda s: s["id"])).scalar()


def encode(text: Column, index: Column) -> Column:
    return F.transform(
        characters(text), lambda c: F.coalesce(F.get(index, F.ascii(c)), F.lit(C.UNK_ID))
    )


def _fixed(text: str, index: Column) -> Column:
    return F.transform(
        F.array(*[F.lit(ord(c)) for c in text]),
        lambda p: F.coalesce(F.get(index, p), F.lit(C.UNK_ID)),
    )


def prefix_ids(text: Column, index: Column, cfg: C.SequenceConfig = C.SequenceConfig()) -> Column:
    """<bos> prefix text mid: the prompt, with the text cut so that all fits ``max_len``."""
    budget = max(1, cfg.max_len - (1 + len(cfg.prefix) + len(cfg.mid)))
    return F.concat(
        F.array(F.lit(C.BOS_ID)),
        _fixed(cfg.prefix, index),
        encode(F.substring(text, 1, budget), index),
        _fixed(cfg.mid, index),
    )


def encode_column(reviews: DataFrame, vocab: DataFrame, text: str = "comment") -> DataFrame:
    """Adds ``ids``."""
    indexed = reviews.withColumn("__index", code_point_index(vocab))
    return indexed.withColumn("ids", encode(F.col(text), F.col("__index"))).drop("__index")


def encode_prompts(reviews: DataFrame, vocab: DataFrame,
                   cfg: C.SequenceConfig = C.SequenceConfig(), text: str = "comment") -> DataFrame:
    """Adds ``ids`` of the prompt without answers."""
    indexed = reviews.withColumn("__index", code_point_index(vocab))
    return indexed.withColumn("ids", prefix_ids(F.col(text), F.col("__index"), cfg)).drop("__index")


def encode_supervised(reviews: DataFrame, vocab: DataFrame,
                      cfg: C.SequenceConfig = C.SequenceConfig(), text: str = "comment",
                      star: str = "star") -> DataFrame:
    """Adds ``ids`` and ``labels``. Only the sentiment, rating and <eos> slots carry a label;
    neutral reviews have no sentiment slot."""
    fixed = 1 + len(cfg.prefix) + len(cfg.mid) + 1 + len(cfg.sep) + 2
    budget = max(1, cfg.max_len - fixed)
    i = F.col("__index")
    ignore = F.lit(C.IGNORE_LABEL)
    sentiment = (
        F.when(star_label(F.col(star)) == 1, _fixed(C.POSITIVE_CHAR, i))
        .when(star_label(F.col(star)) == 0, _fixed(C.NEGATIVE_CHAR, i))
        .otherwise(F.array().cast("array<int>"))
    )
    rating = F.array(F.coalesce(F.get(i, F.ascii(F.col(star).cast("string"))), F.lit(C.UNK_ID)))
    eos = F.array(F.lit(C.EOS_ID))
    head = F.concat(
        F.array(F.lit(C.BOS_ID)),
        _fixed(cfg.prefix, i),
        encode(F.substring(text, 1, budget), i),
        _fixed(cfg.mid, i),
    )
    out = (
        reviews.withColumn("__index", code_point_index(vocab))
        .withColumn("__head", head)
        .withColumn("__sent", sentiment)
        .withColumn("__rate", rating)
        .withColumn("ids", F.concat("__head", "__sent", _fixed(cfg.sep, i), "__rate", eos))
        .withColumn(
            "labels",
            F.concat(
                F.array_repeat(ignore, F.size("__head")),
                F.col("__sent"),
                F.array_repeat(ignore, len(cfg.sep)),
                F.col("__rate"),
                eos,
            ),
        )
    )
    return out.drop("__index", "__head", "__sent", "__rate")


def sequence_stats(sequences: DataFrame, by: str = "split") -> DataFrame:
    n = F.size("ids")
    return sequences.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(n).alias("tokens"), F.max(n).alias("longest")
    )


def batch_plan(sequences: DataFrame, cfg: C.BatchConfig = C.BatchConfig(),
               ids: str = "ids") -> DataFrame:
    """Rows, batch size, batches and padding waste per length bucket."""
    return _plan_of(sequences, F.size(ids), cfg)


def _plan_of(sequences: DataFrame, n: Column, cfg: C.BatchConfig) -> DataFrame:
    w = cfg.bucket_width
    buckets = sequences.groupBy(F.ceil(n / w).cast("bigint").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(n).alias("tokens")
    )
    fit = F.floor(F.lit(cfg.token_budget) / F.greatest(F.lit(1), F.col("bucket") * w))
    size = F.greatest(F.lit(cfg.min_batch), F.least(F.lit(cfg.batch_size), fit)).cast("bigint")
    return (
        buckets.withColumn("batch_size", size)
        .withColumn("batches", F.ceil(F.col("n_rows") / F.col("batch_size")).cast("bigint"))
        .withColumn("padded_tokens", F.col("bucket") * w * F.col("n_rows"))
    )


def batched_sequences(sequences: DataFrame, cfg: C.BatchConfig = C.BatchConfig(),
                      ids: str = "ids", row_id: str = "row_id") -> DataFrame:
    """``row_id, bucket, length, batch, slot``: the batches of ``batch_plan`` as data. Sequences
    are ordered by length (ties by id) and cut into batches inside each length bucket; batches
    count from 0 over all buckets.

    The sequences are read once, into lengths that are stored. The places come from a range sort
    (``dense_index``), so a bucket may hold most of the rows.
    The plan, one row per bucket, has at most the longest length over the bucket width.
    """
    from plaudit.operators.scale import dense_index, stable_copy

    lengths = stable_copy(sequences.select(row_id, F.size(ids).alias("length")))
    plan = _plan_of(lengths, F.col("length"), cfg)
    earlier = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = plan.select(
        F.col("bucket").alias("__bucket"), "batch_size",
        F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).alias("__row"),
        F.coalesce(F.sum("batches").over(earlier), F.lit(0)).alias("__batch"),
    )
    rows = lengths.select(row_id, F.ceil(F.col("length") / cfg.bucket_width).cast("bigint").alias("bucket"), "length")
    placed = dense_index(rows, ["bucket", "length", row_id], "__at")
    met = placed.join(F.broadcast(starts), F.col("bucket") == F.col("__bucket"))
    here = F.col("__at") - F.col("__row")
    return met.select(
        row_id, "bucket", "length",
        (F.col("__batch") + F.floor(here / F.col("batch_size"))).cast("bigint").alias("batch"),
        (here % F.col("batch_size")).cast("bigint").alias("slot"),
    )


def pad_sequences(sequences: DataFrame, by: list[str], ids: str = "ids", multiple: int = 16,
                  pad: int = C.PAD_ID, labels: str | None = None) -> DataFrame:
    """Adds ``padded``: every sequence of a batch (the columns ``by``) filled up to the longest
    one, rounded up to ``multiple``; with ``labels`` also ``padded_labels``, filled with the label
    that is ignored. The width is grouped first and joined back, salted."""
    from plaudit.operators.scale import attach_group_values

    widths = sequences.groupBy(*by).agg(
        (F.ceil(F.max(F.size(ids)) / multiple) * multiple).cast("int").alias("width"),
        F.count(F.lit(1)).alias("__rows"),
    )
    wide = attach_group_values(sequences, widths, by, "__rows", [ids]).drop("__rows")
    missing = F.col("width") - F.size(ids)
    padded = {"padded": F.concat(ids, F.array_repeat(F.lit(pad), missing))}
    if labels is not None:
        padded["padded_labels"] = F.concat(labels, F.array_repeat(F.lit(C.IGNORE_LABEL), missing))
    return wide.withColumns(padded)
