"""The catalogue: every operator as a query over the given tables, with oracle SQL where plain
SQL can state it. Sums of floats are rounded to six digits, because engines add in any order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.functions import scoring as S
from plaudit.functions import text as T
from plaudit.operators import aspects as A
from plaudit.operators import checks as Q
from plaudit.operators import cleaning as N
from plaudit.operators import cube as U
from plaudit.operators import evaluation as E
from plaudit.operators import keywords as K
from plaudit.operators import lexicon as L
from plaudit.operators import models as M
from plaudit.operators import ratings as R
from plaudit.operators import sampling as P
from plaudit.operators import segmentation as G
from plaudit.operators import serving as V
from plaudit.operators import sketches as H
from plaudit.operators import spam as X
from plaudit.operators import states as Z
from plaudit.operators import vocab as B
from plaudit.operators.scale import shared_folder, stable_copy
from plaudit.plans import oracle_parts as O
from plaudit.sources import driver_tables as D
from plaudit.sources import readers, sinks
from plaudit.sources.csv_blocks import read_csv_blocks
from plaudit.streaming import jobs, seen

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _r(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def _sql_r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _joined(col: str, sep: str = " ") -> Column:
    return F.array_join(F.col(col).cast("array<string>"), sep).alias(col)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return N.clean_reviews(D.reviews(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return M.attach_lexicon_scores(clean(spark, sf), D.SENTIMENT)


def unique_scored(spark: SparkSession, sf: str) -> DataFrame:
    return M.attach_lexicon_scores(N.dedup_keep_first(clean(spark, sf)), D.SENTIMENT)


def clause_score(clause: Column) -> Column:
    return S.lexicon_p_pos(clause, D.SENTIMENT)


# --- sources and sinks --------------------------------------------------------

_PRED = ["row_id", "item", "star", "likes", "p_pos", "pred_sent", "exp_rating", "pred_rating", "p_rating"]


@query(O.base_scored() + f"SELECT row_id, item, star, likes, p_pos, pred_sent, {_sql_r('exp_rating')}, pred_rating, {_sql_r('p_rating')} FROM scored")
def prediction_shards(spark, sf):
    """Segments written one by one, one of them twice, and read back as one table."""
    path = shared_folder(spark) + "/predictions"
    preds = scored(spark, sf).select(*_PRED)
    sinks.write_segments(preds, path, 250)
    sinks.write_segments(preds, path, 250, start=0, end=500)
    back = readers.read_predictions(spark, path)
    return back.select("row_id", "item", "star", "likes", "p_pos", "pred_sent", *_r("exp_rating"), "pred_rating", *_r("p_rating"))


@query("WITH " + O.REVIEWS + " SELECT row_id, star, likes FROM reviews WHERE item = 'src3'")
def item_scan(spark, sf):
    return D.reviews(spark, sf).filter(F.col("item") == "src3").select("row_id", "star", "likes")


@query(O.base() + "SELECT row_id, item, item_label, user_id, day_no, star, likes, comment FROM clean")
def csv_round_trip(spark, sf):
    """Raw CSV written and read with quoting, mapped to reviews and cleaned."""
    path = shared_folder(spark) + "/raw"
    rows = D.reviews(spark, sf)
    raw = rows.select(
        F.col("row_id").alias("ID"),
        F.col("item_label").alias("Movie_Name_EN"),
        F.col("item").alias("Movie_Name_CN"),
        F.lit("2024-01-01").alias("Crawl_Date"),
        F.lit(1).alias("Number"),
        F.col("user_id").cast("string").alias("Username"),
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("day_no")).cast("string").alias("Date"),
        F.col("star").alias("Star"),
        F.col("comment").alias("Comment"),
        F.col("likes").alias("Like"),
    )
    sinks.write_csv(raw, path)
    back = readers.as_reviews(readers.read_raw_csv(spark, path))
    typed = back.withColumn("user_id", F.col("user_id").cast("bigint"))
    return N.clean_reviews(typed).select("row_id", "item", "item_label", "user_id", "day_no", "star", "likes", "comment")


_BROKEN = "replace(comment, 'e ', 'e\"' || chr(13) || chr(10) || '\",')"


@query("WITH " + O.REVIEWS + f" SELECT row_id, item, {_BROKEN} AS comment, likes FROM reviews WHERE comment <> ''")
def csv_in_blocks(spark, sf):
    """Texts full of quotes, commas and line breaks, written as CSV and read by blocks."""
    path = shared_folder(spark) + "/broken"
    rows = D.reviews(spark, sf).filter("comment <> ''").select("row_id", "item", F.expr(_BROKEN).alias("comment"), "likes")
    sinks.write_csv(rows, path)
    return read_csv_blocks(spark, path, rows.schema)


# --- cleaning -----------------------------------------------------------------


@query("WITH " + O.REVIEWS + f" SELECT row_id, {O.cleaned('comment')} AS comment FROM reviews")
def clean_text(spark, sf):
    return D.reviews(spark, sf).select("row_id", T.clean_text(F.col("comment")).alias("comment"))


@query(O.base() + "SELECT row_id, item, star, length(comment) AS chars FROM clean")
def length_star_filter(spark, sf):
    return clean(spark, sf).select("row_id", "item", "star", F.length("comment").cast("bigint").alias("chars"))


@query("WITH " + O.REVIEWS + f" SELECT row_id, star, {O.label()} AS label FROM reviews")
def star_label(spark, sf):
    return D.reviews(spark, sf).select("row_id", "star", S.star_label(F.col("star")).alias("label"))


@query(O.base(source="uniq") + "SELECT row_id, item, user_id, md5(comment) AS digest FROM uniq")
def dedup_keep_first(spark, sf):
    return N.dedup_keep_first(clean(spark, sf)).select("row_id", "item", "user_id", F.md5("comment").alias("digest"))


@query("WITH " + O.REVIEWS + """ SELECT row_number() OVER (ORDER BY item) - 1 AS item_id, item, item_label
FROM (SELECT item, arg_min(item_label, row_id) AS item_label FROM reviews GROUP BY item)""")
def item_dim(spark, sf):
    return N.item_dimension(D.reviews(spark, sf))


@query(O.base() + """, known AS (SELECT DISTINCT item FROM clean WHERE star <> 3),
dim AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS item_id FROM known)
SELECT row_id, clean.item, coalesce(item_id, -1) AS item_id FROM clean LEFT JOIN dim ON clean.item = dim.item""")
def item_id_map(spark, sf):
    rows = clean(spark, sf)
    dim = N.item_dimension(rows.filter(F.col("star") != 3))
    return N.map_item_ids(rows, dim).select("row_id", "item", "item_id")


@query(O.base() + "SELECT row_id, item FROM clean ORDER BY row_id LIMIT 500")
def first_rows(spark, sf):
    return N.first_rows(clean(spark, sf), 500).select("row_id", "item")


@query("WITH " + O.REVIEWS + """,
l AS (SELECT length(comment) AS n FROM reviews),
i AS (SELECT item, count(*) AS n FROM reviews GROUP BY item),
c AS (SELECT count(*) - 1 AS extra FROM reviews GROUP BY item, user_id, comment)
SELECT (SELECT count(*) FROM l) AS n_rows, (SELECT count(*) FROM i) AS n_items,
  (SELECT CAST(sum(extra) AS BIGINT) FROM c) AS dup_global,
  (SELECT count(*) FROM l WHERE coalesce(n, 0) = 0) AS empty_comment,
  (SELECT round(avg(n), 6) FROM l) AS len_mean,
  (SELECT quantile_cont(n, 0.5) FROM l) AS len_p50, (SELECT quantile_cont(n, 0.9) FROM l) AS len_p90,
  (SELECT round(quantile_cont(n, 0.99), 6) FROM l) AS len_p99, (SELECT max(n) FROM l) AS len_max,
  (SELECT count(*) FROM i WHERE n >= 100) AS items_ge100,
  (SELECT count(*) FROM i WHERE n >= 1000) AS items_ge1000,
  (SELECT count(*) FROM i WHERE n < 10) AS items_lt10""")
def corpus_profile(spark, sf):
    out = N.corpus_profile(D.reviews(spark, sf))
    return out.withColumn("len_max", F.col("len_max").cast("bigint")).withColumn(
        "len_mean", F.round("len_mean", 6)).withColumn("len_p99", F.round("len_p99", 6))


@query("WITH " + O.REVIEWS + " SELECT star, count(*) AS n FROM reviews GROUP BY star")
def star_histogram(spark, sf):
    return N.star_histogram(D.reviews(spark, sf))


@query("WITH " + O.REVIEWS + " SELECT item, count(*) AS n FROM reviews GROUP BY item ORDER BY n DESC, item LIMIT 20")
def largest_items(spark, sf):
    return N.largest_items(D.reviews(spark, sf))


# --- vocabulary and sequences ---------------------------------------------------

_SEQ = C.SequenceConfig(max_len=144)
_FORCED = B.forced_tokens(_SEQ)
_VOCAB_SQL = f"""char_list AS (SELECT unnest(string_split(comment, '')) AS token FROM clean),
freqs AS (SELECT token, count(*) AS freq FROM char_list WHERE token <> '' GROUP BY token),
vocab AS (SELECT CAST(unnest(range({len(_FORCED)})) AS BIGINT) AS id, unnest([{O.words(_FORCED)}]) AS token, NULL::BIGINT AS freq
  UNION ALL SELECT {len(_FORCED)} + row_number() OVER (ORDER BY freq DESC, token) - 1, token, freq FROM (
    SELECT * FROM freqs WHERE freq >= 3 AND token NOT IN ({O.words(_FORCED)})
    ORDER BY freq DESC, token LIMIT {_SEQ.vocab_size - len(_FORCED)})),
index_row AS (SELECT map(list(token), list(id)) AS m FROM vocab WHERE length(token) = 1)"""


def _ids_sql(text: str) -> str:
    return f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: coalesce(m[c], 3))"


_PROMPT = f"list_concat([1], {_ids_sql(O.q(_SEQ.prefix))}, {_ids_sql(f'substring(comment, 1, {_SEQ.max_len - 1 - len(_SEQ.prefix) - len(_SEQ.mid)})')}, {_ids_sql(O.q(_SEQ.mid))})"
_FULL_BUDGET = _SEQ.max_len - (1 + len(_SEQ.prefix) + len(_SEQ.mid) + 1 + len(_SEQ.sep) + 2)
_HEAD = f"list_concat([1], {_ids_sql(O.q(_SEQ.prefix))}, {_ids_sql(f'substring(comment, 1, {_FULL_BUDGET})')}, {_ids_sql(O.q(_SEQ.mid))})"
_SUPERVISED = f"""heads AS (SELECT row_id, star, {_HEAD} AS head,
  CASE WHEN star >= 4 THEN {_ids_sql(O.q(C.POSITIVE_CHAR))} WHEN star <= 2 THEN {_ids_sql(O.q(C.NEGATIVE_CHAR))} ELSE [] END AS sent,
  {_ids_sql("CAST(star AS VARCHAR)")} AS rate, {_ids_sql(O.q(_SEQ.sep))} AS sep FROM clean, index_row),
supervised AS (SELECT row_id, list_concat(head, sent, sep, rate, [2]) AS ids,
  list_concat(list_transform(head, lambda x: -100), sent, list_transform(sep, lambda x: -100), rate, [2]) AS labels FROM heads)"""


@query(O.base(_VOCAB_SQL) + "SELECT token, freq FROM freqs")
def char_freq(spark, sf):
    return B.char_counts(clean(spark, sf))


@query(O.base(_VOCAB_SQL) + "SELECT id, token, freq FROM vocab")
def vocab_top(spark, sf):
    return B.build_vocab(clean(spark, sf), _SEQ)


@query(O.base(_VOCAB_SQL) + f"SELECT row_id, array_to_string({_ids_sql('comment')}, ' ') AS ids FROM clean, index_row")
def encode_ids(spark, sf):
    rows = clean(spark, sf)
    return B.encode_column(rows, B.build_vocab(rows, _SEQ)).select("row_id", _joined("ids"))


@query(O.base(_VOCAB_SQL) + f"SELECT row_id, array_to_string({_PROMPT}, ' ') AS ids FROM clean, index_row")
def encode_prompt(spark, sf):
    rows = clean(spark, sf)
    return B.encode_prompts(rows, B.build_vocab(rows, _SEQ), _SEQ).select("row_id", _joined("ids"))


def _supervised(spark, sf):
    rows = clean(spark, sf)
    return B.encode_supervised(rows, B.build_vocab(rows, _SEQ), _SEQ)


@query(O.base(_VOCAB_SQL, _SUPERVISED) + "SELECT row_id, array_to_string(ids, ' ') AS ids, array_to_string(labels, ' ') AS labels FROM supervised")
def encode_supervised(spark, sf):
    return _supervised(spark, sf).select("row_id", _joined("ids"), _joined("labels"))


_ENCODED = f"encoded AS (SELECT row_id, {_ids_sql('comment')} AS ids FROM clean, index_row)"


def _encoded(spark, sf):
    """Whole texts as ids; the fixed length of a prompt is a matter of encode_prompt alone."""
    rows = clean(spark, sf)
    return B.encode_column(rows, B.build_vocab(rows, _SEQ))


@query(O.base(_VOCAB_SQL, _ENCODED) + """SELECT CASE WHEN (row_id * 2654435761) % 1000 < 10 THEN 'val'
  WHEN (row_id * 2654435761) % 1000 < 200 THEN 'train' ELSE 'rest' END AS split,
  count(*) AS n, CAST(sum(len(ids)) AS BIGINT) AS tokens, CAST(max(len(ids)) AS BIGINT) AS longest FROM encoded GROUP BY 1""")
def split_counts(spark, sf):
    out = B.sequence_stats(P.with_split(_encoded(spark, sf)))
    return out.withColumn("longest", F.col("longest").cast("bigint"))


@query(O.base(_VOCAB_SQL, _ENCODED) + """, b AS (SELECT CAST(ceil(len(ids) / 16.0) AS BIGINT) AS bucket, count(*) AS n_rows,
  CAST(sum(len(ids)) AS BIGINT) AS tokens FROM encoded GROUP BY 1),
s AS (SELECT *, CAST(greatest(8, least(128, 8192 // greatest(1, bucket * 16))) AS BIGINT) AS batch_size FROM b)
SELECT bucket, n_rows, tokens, batch_size, CAST(ceil(n_rows / batch_size::DOUBLE) AS BIGINT) AS batches,
  bucket * 16 * n_rows AS padded_tokens FROM s""")
def batch_plan(spark, sf):
    return B.batch_plan(_encoded(spark, sf))


@query(O.base(_VOCAB_SQL, _ENCODED) + """, b AS (SELECT row_id, CAST(len(ids) AS INT) AS length,
  CAST(ceil(len(ids) / 16.0) AS BIGINT) AS bucket FROM encoded),
p AS (SELECT bucket, count(*) AS n, CAST(greatest(8, least(128, 8192 // greatest(1, bucket * 16))) AS BIGINT) AS size FROM b GROUP BY bucket),
s AS (SELECT *, coalesce(sum((n + size - 1) // size) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY length, row_id) - 1 AS place FROM b)
SELECT row_id, bucket, length, CAST(before + place // size AS BIGINT) AS batch, CAST(place % size AS BIGINT) AS slot FROM r JOIN s USING (bucket)""")
def sequence_batches(spark, sf):
    """Every sequence with its batch of like lengths and its place there."""
    return B.batched_sequences(_encoded(spark, sf))


@query(O.base(_VOCAB_SQL, _ENCODED) + """, t AS (SELECT row_id, ids, CAST(ceil(len(ids) / 16.0) AS BIGINT) AS bucket FROM encoded),
w AS (SELECT bucket, CAST(ceil(max(len(ids)) / 16.0) * 16 AS INT) AS width FROM t GROUP BY bucket)
SELECT row_id, bucket, width, array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda x: 0)), ' ') AS padded
FROM t JOIN w USING (bucket)""")
def padded_sequences(spark, sf):
    rows = _encoded(spark, sf).select("row_id", "ids", F.ceil(F.size("ids") / 16).cast("bigint").alias("bucket"))
    return B.pad_sequences(rows, ["bucket"]).select("row_id", "bucket", "width", _joined("padded"))


@query(O.base(_VOCAB_SQL, _SUPERVISED) + """, t AS (SELECT row_id, ids, labels, CAST(ceil(len(ids) / 16.0) AS BIGINT) AS bucket FROM supervised),
w AS (SELECT bucket, CAST(ceil(max(len(ids)) / 16.0) * 16 AS INT) AS width FROM t GROUP BY bucket)
SELECT row_id, bucket, array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda x: 0)), ' ') AS padded,
  array_to_string(list_concat(labels, list_transform(range(width - len(ids)), lambda x: -100)), ' ') AS padded_labels
FROM t JOIN w USING (bucket)""")
def padded_labels(spark, sf):
    """Ids and labels of the supervised sequences, filled up to the width of their batch."""
    bucket = F.ceil(F.size("ids") / 16).cast("bigint").alias("bucket")
    rows = _supervised(spark, sf).select("row_id", "ids", "labels", bucket)
    wide = B.pad_sequences(rows, ["bucket"], labels="labels")
    return wide.select("row_id", "bucket", _joined("padded"), _joined("padded_labels"))


# --- splits and samples ---------------------------------------------------------


@query(O.base() + """SELECT row_id, CAST((row_id * 2654435761) % 1000 AS INT) AS bucket,
  CASE WHEN (row_id * 2654435761) % 1000 < 10 THEN 'val' WHEN (row_id * 2654435761) % 1000 < 200 THEN 'train' ELSE 'rest' END AS split FROM clean""")
def hash_split(spark, sf):
    return P.with_split(clean(spark, sf)).select("row_id", "bucket", "split")


@query(O.base() + f"""SELECT row_id, item FROM (SELECT row_id, item, row_number() OVER (
  PARTITION BY item ORDER BY {O.spread('row_id', 42)}, row_id) AS rn FROM clean) WHERE rn <= 20""")
def sample_per_item(spark, sf):
    return P.sample_reviews_per_item(clean(spark, sf), 20, 42).select("row_id", "item")


@query(O.base() + f"""SELECT row_id FROM (SELECT row_id, row_id // 250 AS block, row_number() OVER (
  PARTITION BY row_id // 250 ORDER BY {O.spread('row_id', 0)}, row_id) AS rn FROM clean) WHERE rn <= 60
  ORDER BY {O.spread('row_id', 0)}, row_id LIMIT 200""")
def sample_texts(spark, sf):
    return P.sample_texts(clean(spark, sf), 200, 60, 250).select("row_id")


@query(O.base() + f"SELECT row_id, star FROM clean ORDER BY {O.spread('row_id', 7)}, row_id LIMIT 300")
def random_subset(spark, sf):
    return P.random_subset(clean(spark, sf), 300, 7).select("row_id", "star")


# --- scoring --------------------------------------------------------------------


@query(O.base(O.scored("clean")) + "SELECT row_id, p_pos FROM scored")
def lexicon_score(spark, sf):
    return scored(spark, sf).select("row_id", "p_pos")


@query(O.base_scored() + "SELECT row_id, p_pos, CAST(CASE WHEN p_pos >= 0.3 THEN 1 ELSE 0 END AS INT) AS pred_sent FROM scored")
def verdict(spark, sf):
    return M.attach_lexicon_scores(clean(spark, sf), D.SENTIMENT, 0.3).select("row_id", "p_pos", "pred_sent")


@query(O.base_scored() + f"SELECT row_id, {_sql_r('exp_rating')}, pred_rating, {_sql_r('p_rating')} FROM scored")
def rating_expectation(spark, sf):
    return scored(spark, sf).select("row_id", *_r("exp_rating"), "pred_rating", *_r("p_rating"))


@query(O.base_scored() + "SELECT row_id, round(exp(ln(p_pos)) / (exp(ln(p_pos)) + exp(ln(1 - p_pos))), 6) AS p_pos FROM scored")
def sentiment_softmax(spark, sf):
    p = F.col("p_pos")
    return scored(spark, sf).select("row_id", F.round(S.pair_softmax(F.ln(p), F.ln(1 - p)), 6).alias("p_pos"))


@query(O.base_scored() + f"""SELECT md5(comment) AS digest, CASE WHEN p_pos >= 0.5 THEN 'positive' ELSE 'negative' END AS sentiment,
  p_pos, 0.5::DOUBLE AS threshold, {_sql_r('exp_rating').replace('AS exp_rating', 'AS pred_rating')}, pred_rating AS rating_argmax,
  round(p_rating, 6) AS confidence FROM scored""")
def prediction_records(spark, sf):
    return M.prediction_record(scored(spark, sf)).select(
        F.md5("text").alias("digest"), "sentiment", "p_pos", "threshold", *_r("pred_rating"), "rating_argmax", *_r("confidence"))


def _ml_train(spark, sf):
    split = P.with_split(clean(spark, sf), C.SplitConfig(val_below=100, train_below=1000))
    return split.filter(F.col("split") == "train"), split


@query()
def ml_scores(spark, sf):
    """Spark ML scorer trained on stars, applied to all reviews."""
    train, everything = _ml_train(spark, sf)
    model = M.fit_review_model(train)
    return M.score_reviews(model, everything).select("row_id", "split", "star", *_PRED[4:])


@query(O.base() + f"""SELECT CASE WHEN (row_id * {C.HASH_MULTIPLIER}) % 1000 < 100 THEN 'val' ELSE 'train' END AS split, count(*) AS n,
  true AS in_range, true AS verdict_follows, true AS not_below_majority FROM clean GROUP BY 1""")
def ml_score_facts(spark, sf):
    """What must hold for the trained scorer: rows, ranges, verdicts and an accuracy on the stars
    of the training rows that is not below that of the more frequent label (on other rows no
    bound holds for certain, and the column is true)."""
    rows = ml_scores(spark, sf)
    label = S.star_label(F.col("star"))
    good, polar = F.count_if(label == 1), F.count_if(label >= 0)
    right = F.count_if((label >= 0) & (label == F.col("pred_sent")))
    ranges = F.col("p_pos").between(0, 1) & F.col("exp_rating").between(1, 5) & F.col("pred_rating").between(1, 5) & F.col("p_rating").between(0.2, 1)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(ranges).alias("in_range"),
        F.bool_and((F.col("p_pos") >= 0.5) == (F.col("pred_sent") == 1)).alias("verdict_follows"),
        (right >= F.greatest(good, polar - good)).alias("__right"),
    ).select("split", "n", "in_range", "verdict_follows", (F.col("__right") | (F.col("split") != "train")).alias("not_below_majority"))


@query(O.base_scored() + f"SELECT row_id, p_pos, pred_sent, {_sql_r('exp_rating')}, pred_rating, {_sql_r('p_rating')} FROM scored")
def plugged_scores(spark, sf):
    """A Python scorer over Arrow batches, loaded once per task."""
    positive, negative = D.SENTIMENT.positive, D.SENTIMENT.negative
    whole = lambda words: f"(?<![a-z])(?:{'|'.join(words)})(?![a-z])"

    def load():
        import numpy as np
        import pandas as pd

        def score(texts):
            lower = texts.str.lower()
            pos = lower.str.count(whole(positive)).to_numpy()
            neg = lower.str.count(whole(negative)).to_numpy()
            p = (pos + 1.0) / (pos + neg + 2.0)
            q = 1 - p
            dist = np.stack([q * q * q * q, 4 * p * q * q * q, 6 * p * p * q * q, 4 * p * p * p * q, p * p * p * p], 1)
            return pd.DataFrame({
                "p_pos": p, "pred_sent": (p >= 0.5).astype("int32"),
                "exp_rating": dist @ np.arange(1.0, 6.0),
                "pred_rating": (dist.argmax(1) + 1).astype("int32"), "p_rating": dist.max(1)})

        return score

    out = M.score_in_batches(clean(spark, sf), load, ["row_id"])
    return out.select("row_id", "p_pos", "pred_sent", *_r("exp_rating"), "pred_rating", *_r("p_rating"))


# --- evaluation -----------------------------------------------------------------

_EVAL = f"eval_rows AS (SELECT row_id, {O.label()} AS label, p_pos AS p FROM scored WHERE star <> 3)"
_STEPS = """steps AS (SELECT p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM eval_rows GROUP BY p),
cums AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
  (SELECT sum(pos) FROM steps) AS total_pos FROM steps),
rates AS (SELECT p, tp / greatest(1, tp + fp)::DOUBLE AS pr, tp / greatest(1, total_pos)::DOUBLE AS rc FROM cums),
f1s AS (SELECT p, 2 * pr * rc / greatest(pr + rc, 1e-9) AS f1 FROM rates),
best AS (SELECT p AS threshold, f1 AS f1_pos FROM f1s ORDER BY f1 DESC, p DESC LIMIT 1)"""


def _confusion_sql(threshold: str) -> str:
    return f"""counted AS (SELECT {threshold} AS threshold,
  count(*) FILTER (WHERE p >= {threshold} AND label = 1) AS tp, count(*) FILTER (WHERE p >= {threshold} AND label = 0) AS fp,
  count(*) FILTER (WHERE p < {threshold} AND label = 1) AS fn, count(*) AS n FROM eval_rows),
pr AS (SELECT *, tp / greatest(1, tp + fp)::DOUBLE AS precision_pos, tp / greatest(1, tp + fn)::DOUBLE AS recall_pos FROM counted)
SELECT threshold, tp, fp, fn, n, round((n - fp - fn) / n::DOUBLE, 6) AS acc, {_sql_r('precision_pos', 'recall_pos')},
  round(2 * precision_pos * recall_pos / greatest(precision_pos + recall_pos, 1e-9), 6) AS f1_pos,
  round((tp + fp) / n::DOUBLE, 6) AS pos_rate_pred, round((tp + fn) / n::DOUBLE, 6) AS pos_rate_true FROM pr"""


def _eval(spark, sf):
    return scored(spark, sf).select(
        "row_id", "star", S.star_label(F.col("star")).alias("label"), F.col("p_pos").alias("p"), "pred_sent", "pred_rating")


def _rounded_confusion(df: DataFrame) -> DataFrame:
    return df.select("threshold", "tp", "fp", "fn", "n", *_r("acc", "precision_pos", "recall_pos", "f1_pos", "pos_rate_pred", "pos_rate_true"))


@query(O.base_scored(_EVAL, _confusion_sql("0.5::DOUBLE").split("\nSELECT")[0]) + "SELECT" + _confusion_sql("0.5::DOUBLE").split("\nSELECT")[1])
def confusion_metrics(spark, sf):
    return _rounded_confusion(E.confusion(_eval(spark, sf)))


@query(O.base_scored() + "SELECT round(avg((pred_rating = star)::INT), 6) AS rating_acc, round(avg(abs(pred_rating - star)), 6) AS rating_mae, count(*) AS n FROM scored")
def rating_mae(spark, sf):
    return E.rating_error(_eval(spark, sf)).select(*_r("rating_acc", "rating_mae"), "n")


@query(O.base_scored(_EVAL, _STEPS) + "SELECT threshold, round(f1_pos, 6) AS f1_pos FROM best")
def best_threshold(spark, sf):
    return E.best_threshold(_eval(spark, sf)).select("threshold", *_r("f1_pos"))


_CAL = _confusion_sql("(SELECT threshold FROM best)")


_VAL_SPLIT = C.SplitConfig(val_below=300, train_below=600)
_VAL_EVAL = _EVAL.replace("WHERE star <> 3", f"WHERE star <> 3 AND (row_id * {C.HASH_MULTIPLIER}) % 1000 < 300")


@query(O.base_scored(_VAL_EVAL, _STEPS) + "SELECT row_id, threshold, CAST(CASE WHEN p_pos >= threshold THEN 1 ELSE 0 END AS INT) AS pred_sent FROM scored, best")
def calibrated_verdict(spark, sf):
    """The threshold found on the validation rows, applied to all reviews."""
    val = P.with_split(_eval(spark, sf), _VAL_SPLIT).filter(F.col("split") == "val")
    threshold = E.best_threshold(val).select("threshold").scalar()
    rows = scored(spark, sf).select("row_id", "p_pos").withColumn("threshold", threshold)
    return rows.select("row_id", "threshold", S.verdict(F.col("p_pos"), F.col("threshold")).alias("pred_sent"))


@query(O.base_scored(_EVAL, _STEPS, _CAL.split("\nSELECT")[0]) + "SELECT" + _CAL.split("\nSELECT")[1])
def calibration_record(spark, sf):
    return _rounded_confusion(E.calibrate(_eval(spark, sf)))


_MODELS_SQL = f"""cand AS (SELECT '0.3' AS model, 0.3::DOUBLE AS t UNION ALL SELECT '0.5', 0.5 UNION ALL SELECT '0.7', 0.7),
e2 AS (SELECT {O.label()} AS label, p_pos AS p, pred_rating, star FROM scored),
m AS (SELECT model, count(*) FILTER (WHERE label >= 0 AND p >= t AND label = 1) AS tp, count(*) FILTER (WHERE p >= t AND label = 0) AS fp,
  count(*) FILTER (WHERE p < t AND label = 1) AS fn, count(*) FILTER (WHERE label >= 0) AS n, avg(abs(pred_rating - star)) AS mae FROM e2, cand GROUP BY model),
m2 AS (SELECT *, tp / greatest(1, tp + fp)::DOUBLE AS pr, tp / greatest(1, tp + fn)::DOUBLE AS rc FROM m)
SELECT model, round((n - fp - fn) / n::DOUBLE + 2 * pr * rc / greatest(pr + rc, 1e-9) - mae / 4, 6) AS selection FROM m2
ORDER BY selection DESC, model LIMIT 1"""


@query(O.base_scored(_MODELS_SQL.split("\nSELECT model, round")[0]) + "SELECT model, round" + _MODELS_SQL.split("\nSELECT model, round")[1])
def model_selection(spark, sf):
    """Best of three thresholds by the selection score."""
    rows = _eval(spark, sf)
    mae = E.rating_error(rows).select("rating_mae").scalar()
    runs = [E.confusion(rows, t).withColumn("model", F.lit(str(t))).withColumn("rating_mae", mae) for t in (0.3, 0.5, 0.7)]
    return E.best_model(Q.all_checks(*runs)).select("model", *_r("selection"))


@query(O.base_scored() + f"SELECT {O.label()} AS label, pred_sent, count(*) AS n FROM scored GROUP BY ALL")
def star_model_agreement(spark, sf):
    return E.star_model_agreement(_eval(spark, sf))


@query(O.base_scored(_EVAL) + """, steps AS (SELECT p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM eval_rows GROUP BY p),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM steps)
SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))::DOUBLE, 6) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c""")
def auc_rank(spark, sf):
    return E.auc(_eval(spark, sf)).select(*_r("auc"), "n_pos", "n_neg")


# --- aspects --------------------------------------------------------------------


@query(O.base(O.CLAUSES) + "SELECT row_id, CAST(generate_subscripts(cs, 1) - 1 AS INT) AS pos, unnest(cs) AS clause FROM clause_list")
def clause_split(spark, sf):
    return A.clause_rows(clean(spark, sf), D.ASPECTS)


_ALL_HITS = O.HITS.replace("mentions AS", "every AS (SELECT row_id, clause, unnest(aspects) AS aspect FROM hits),\nmentions AS")


@query(O.base(O.CLAUSES, _ALL_HITS) + "SELECT row_id, clause, aspect FROM every")
def aspect_hits(spark, sf):
    parts = F.array_distinct(T.clauses(F.col("comment"), D.ASPECTS.clause_pattern, D.ASPECTS.min_clause_chars))
    rows = clean(spark, sf).select("row_id", F.explode(parts).alias("clause"))
    return rows.select("row_id", "clause", F.explode(T.clause_aspects(F.col("clause"), D.ASPECTS.lexicon)).alias("aspect"))


def _mentions(spark, sf):
    return A.aspect_mentions(clean(spark, sf), clause_score, D.ASPECTS)


@query(O.base(O.CLAUSES, O.HITS) + "SELECT row_id, pos, clause, aspect FROM mentions WHERE pos < 3")
def aspect_top3_clauses(spark, sf):
    """The option of mining only the first three hit clauses of a review."""
    cfg = replace(D.ASPECTS, clauses_per_review=3)
    return A.aspect_mentions(clean(spark, sf), clause_score, cfg).select("row_id", "pos", "clause", "aspect")


@query(O.base(O.CLAUSES, O.HITS) + "SELECT row_id, pos, aspect, p FROM mentions")
def aspect_clause_scores(spark, sf):
    """Each distinct clause scored once, the scores joined back."""
    hits = A.aspect_mentions(clean(spark, sf), clause_score, D.ASPECTS).drop("p")
    back = M.score_distinct_texts(hits, "clause", lambda d: d.withColumn("p", clause_score(F.col("clause"))))
    return back.select("row_id", "pos", "aspect", "p")


@query(O.base(O.CLAUSES, O.HITS, O.RATES) + f"SELECT item, aspect, mentions, {_sql_r('pos_rate', 'like_weighted_pos_rate')} FROM rates")
def aspect_rollup(spark, sf):
    return A.aspect_rates(_mentions(spark, sf)).select("item", "aspect", "mentions", *_r("pos_rate", "like_weighted_pos_rate"))


@query(O.base(O.CLAUSES, O.HITS, O.EVIDENCE) + "SELECT item, aspect, polarity, CAST(rank AS INT) AS rank, clause, p, likes, row_id FROM evidence")
def aspect_evidence(spark, sf):
    return A.aspect_evidence(stable_copy(_mentions(spark, sf)), D.ASPECTS).drop("strength")


@query(O.base(O.CLAUSES, O.HITS, O.RATES, O.EVIDENCE) + f""",
ev AS (SELECT item, aspect, string_agg(clause, ' / ' ORDER BY rank) FILTER (WHERE polarity = 'pos') AS evidence_pos,
  string_agg(clause, ' / ' ORDER BY rank) FILTER (WHERE polarity = 'neg') AS evidence_neg FROM evidence GROUP BY ALL),
n AS (SELECT item, count(*) AS n_sampled FROM clean GROUP BY item)
SELECT item, CAST(row_number() OVER (PARTITION BY item ORDER BY mentions DESC, aspect) - 1 AS INT) AS pos, n_sampled, aspect, mentions,
  {_sql_r('pos_rate', 'like_weighted_pos_rate')}, coalesce(evidence_pos, '') AS evidence_pos, coalesce(evidence_neg, '') AS evidence_neg
FROM rates JOIN ev USING (item, aspect) JOIN n USING (item)""")
def aspects_nested(spark, sf):
    """All reviews mined and nested per item, then unfolded again for comparison."""
    sample = clean(spark, sf)
    mentions = stable_copy(A.aspect_mentions(sample, clause_score, D.ASPECTS))
    table = A.aspect_table(mentions, D.ASPECTS)
    nested = A.aspects_by_item(table, sample)
    rows = nested.select("item", "n_sampled", F.posexplode("aspects").alias("pos", "a"))
    texts = lambda side: F.array_join(F.transform(F.col(f"a.{side}"), lambda e: e["clause"]), " / ").alias(side)
    return rows.select(
        "item", "pos", "n_sampled", "a.aspect", "a.mentions", F.round("a.pos_rate", 6).alias("pos_rate"),
        F.round("a.like_weighted_pos_rate", 6).alias("like_weighted_pos_rate"), texts("evidence_pos"), texts("evidence_neg"))


_LEXICON = """terms AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{L}]+')) AS w FROM benchmark),
lexicon AS (SELECT 'topic' || (length(w) % 5) AS aspect, w AS keyword FROM terms WHERE length(w) <= 6
  UNION SELECT 'opening', substring(w, 1, 1 + length(w) % 2) FROM terms)"""
_DISTINCT_CLAUSES = """pieces AS (SELECT row_id, item, likes, list_distinct(cs) AS cs FROM clause_list),
pieced AS (SELECT row_id, item, likes, unnest(cs) AS clause FROM pieces)"""
_CONTAINED = """contained AS (SELECT row_id, item, likes, clause, aspect, keyword FROM pieced, lexicon
  WHERE CASE WHEN regexp_matches(keyword, '^[\\x00-\\x7F]*$') THEN contains(lower(clause), lower(keyword)) ELSE contains(clause, keyword) END)"""


def _lexicon(spark, sf):
    """Words of the benchmark texts as a lexicon, and their openings of one or two letters."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")
    words = D.table(spark, sf, "benchmark").select(found).distinct()
    n = F.length("w")
    topics = words.filter(n <= 6).select(F.concat(F.lit("topic"), (n % 5).cast("string")).alias("aspect"), F.col("w").alias("keyword"))
    return topics.union(words.select(F.lit("opening"), F.substring("w", F.lit(1), 1 + n % 2))).distinct()


@query(O.base(O.CLAUSES, _LEXICON, _DISTINCT_CLAUSES, _CONTAINED) + "SELECT aspect, keyword, count(*) AS n_clauses, count(DISTINCT row_id) AS n_reviews FROM contained GROUP BY aspect, keyword")
def lexicon_contains(spark, sf):
    """Clauses that contain a keyword of a lexicon table, counted per review where they are found."""
    parts = F.array_distinct(T.clauses(F.col("comment"), D.ASPECTS.clause_pattern, D.ASPECTS.min_clause_chars))
    rows = stable_copy(clean(spark, sf).select("row_id", F.posexplode(parts).alias("pos", "clause")))
    found = L.contains_join(rows, ["row_id", "pos"], "clause", _lexicon(spark, sf), per=["row_id"])
    return found.groupBy("aspect", "keyword").agg(F.sum("n").alias("n_clauses"), F.count("row_id").alias("n_reviews"))


@query(O.base(O.CLAUSES, _LEXICON, _DISTINCT_CLAUSES, _CONTAINED) + f""", m AS (SELECT DISTINCT row_id, item, likes, clause, aspect, {O.lexicon_p('clause')} AS p FROM contained)
SELECT item, aspect, count(*) AS mentions, round(avg(p), 6) AS pos_rate,
  round(sum({O.LIKE_WEIGHT} * p) / sum({O.LIKE_WEIGHT}), 6) AS like_weighted_pos_rate FROM m GROUP BY item, aspect""")
def lexicon_rates(spark, sf):
    """Aspect rates for a lexicon that is a table."""
    found = L.lexicon_mentions(clean(spark, sf), clause_score, _lexicon(spark, sf), D.ASPECTS)
    return A.aspect_rates(found).select("item", "aspect", "mentions", *_r("pos_rate", "like_weighted_pos_rate"))


_CHOICE = (O.CLAUSES, O.HITS, O.RATES, O.ASPECT_CHOICE)


def _rates(spark, sf):
    return A.aspect_rates(_mentions(spark, sf))


@query(O.base(*_CHOICE) + f"SELECT item, CAST(rank AS INT) AS rank, aspect, mentions, {_sql_r('pos_rate', 'gain')} FROM pros")
def pros(spark, sf):
    return A.pros(_rates(spark, sf), D.ASPECTS).select("item", "rank", "aspect", "mentions", *_r("pos_rate", "gain"))


@query(O.base(*_CHOICE) + f"SELECT item, CAST(rank AS INT) AS rank, aspect, mentions, {_sql_r('pos_rate', 'gain')} FROM cons")
def cons(spark, sf):
    return A.cons(_rates(spark, sf), D.ASPECTS).select("item", "rank", "aspect", "mentions", *_r("pos_rate", "gain"))


@query(O.base(*_CHOICE) + f"SELECT item, CAST(rank AS INT) AS rank, aspect, mentions, {_sql_r('pos_rate')} FROM weak")
def weak_points(spark, sf):
    return A.weak_points(_rates(spark, sf), D.ASPECTS).select("item", "rank", "aspect", "mentions", *_r("pos_rate"))


# --- keywords -------------------------------------------------------------------


_LETTERS, _IDEOGRAPHS = "abcdefghij", "一丁七万丈三上下不与"
_GRAMS = "flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, length(run) - n + 2), lambda i: substring(run, i, n))))"


@query("WITH " + O.REVIEWS + f""", runs AS (SELECT unnest(regexp_extract_all(translate(lower(comment), '{_LETTERS}', '{_IDEOGRAPHS}'), '[一-龥]+|[^\\P{{L}}一-龥]+')) AS run FROM reviews),
tokens AS (SELECT unnest(CASE WHEN regexp_matches(run, '^[一-龥]') THEN {_GRAMS} ELSE [run] END) AS token FROM runs)
SELECT token, count(*) AS n FROM tokens GROUP BY token""")
def cjk_tokens(spark, sf):
    """Tokens of the texts with ten letters written as ideographs: n-grams of ideograph runs."""
    text = F.translate(F.lower("comment"), _LETTERS, _IDEOGRAPHS)
    tokens = D.reviews(spark, sf).select(F.explode(T.word_tokens(text)).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_SEGMENTS = C.SegmentConfig(min_count=20, min_pmi=0.5, min_entropy=0.5)
_MINED = f"""han AS (SELECT unnest(regexp_extract_all(translate(lower(comment), '{_LETTERS}', '{_IDEOGRAPHS}'), '[一-龥]+|[^\\P{{L}}一-龥]+')) AS run FROM reviews),
runs AS (SELECT run, count(*) AS times FROM han WHERE regexp_matches(run, '^[一-龥]') GROUP BY run),
grams AS (SELECT times, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, length(run) - k + 2), lambda i: substring(run, i, k))))) AS gram FROM runs),
counts AS MATERIALIZED (SELECT gram, CAST(sum(times) AS BIGINT) AS n FROM grams GROUP BY gram),
total AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM counts WHERE length(gram) = 1),
often AS (SELECT gram, n FROM counts WHERE n >= {_SEGMENTS.min_count}),
cand AS (SELECT gram AS word, n FROM often WHERE length(gram) BETWEEN 2 AND 4),
lefts AS (SELECT substring(gram, 2) AS word, sum(n * ln(n)) AS s FROM counts WHERE length(gram) > 2 GROUP BY 1),
rights AS (SELECT substring(gram, 1, length(gram) - 1) AS word, sum(n * ln(n)) AS s FROM counts WHERE length(gram) > 2 GROUP BY 1),
halves AS (SELECT word, n, unnest(range(1, length(word))) AS cut_at FROM cand),
bonds AS (SELECT word, min(ln(c.n) + ln(t) - ln(h.n) - ln(e.n)) AS pmi FROM halves c, often h, often e, total
  WHERE h.gram = substring(word, 1, cut_at) AND e.gram = substring(word, cut_at + 1) GROUP BY word),
stats AS MATERIALIZED (SELECT c.word, c.n, pmi, greatest(0.0::DOUBLE, ln(c.n) - coalesce(b.s, 0) / c.n) AS left_entropy,
  greatest(0.0::DOUBLE, ln(c.n) - coalesce(a.s, 0) / c.n) AS right_entropy
  FROM cand c JOIN bonds USING (word) LEFT JOIN lefts b ON b.word = c.word LEFT JOIN rights a ON a.word = c.word)"""
_PATHS = f"""dict AS MATERIALIZED (SELECT word, CAST(round(1000000 * ln(n / t)) AS BIGINT) AS weight FROM (
  SELECT word, n FROM stats WHERE pmi >= {_SEGMENTS.min_pmi} AND least(left_entropy, right_entropy) >= {_SEGMENTS.min_entropy}
  UNION ALL SELECT gram, n FROM counts WHERE length(gram) = 1), total),
paths AS (SELECT run, 0 AS pos, 0::BIGINT AS weight, []::INT[] AS sizes FROM runs
  UNION ALL SELECT run, pos + k, p.weight + d.weight, list_append(sizes, CAST(k AS INT)) FROM paths p, range(1, 5) s(k), dict d
  WHERE pos + k <= length(run) AND d.word = substring(run, pos + 1, k)),
best AS (SELECT run, sizes FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY weight DESC, len(sizes), sizes DESC) AS rn
  FROM paths WHERE pos = length(run)) WHERE rn = 1),
cut AS (SELECT run, unnest(sizes) AS size, unnest(list_transform(range(1, len(sizes) + 1), lambda i: coalesce(list_sum(sizes[1:i-1]), 0))) AS start FROM best),
words AS (SELECT substring(run, CAST(start AS INT) + 1, size) AS token, times FROM cut JOIN runs USING (run)
  UNION ALL SELECT run, 1 FROM han WHERE NOT regexp_matches(run, '^[一-龥]'))"""


def _as_ideographs(spark, sf):
    """The reviews with ten letters written as ideographs, so that they have runs without spaces."""
    return D.reviews(spark, sf).withColumn("comment", F.translate(F.lower("comment"), _LETTERS, _IDEOGRAPHS))


@query("WITH " + O.REVIEWS + f", {_MINED} SELECT word, n, {_sql_r('pmi', 'left_entropy', 'right_entropy')} FROM stats")
def mined_words(spark, sf):
    """Statistics by which the dictionary is chosen."""
    counts = stable_copy(G.gram_counts(_as_ideographs(spark, sf), _SEGMENTS))
    return G.word_statistics(counts, _SEGMENTS).select("word", "n", *_r("pmi", "left_entropy", "right_entropy"))


@query("WITH RECURSIVE " + O.REVIEWS + f", {_MINED}, {_PATHS} SELECT token, CAST(sum(times) AS BIGINT) AS n FROM words GROUP BY token")
def segmented_tokens(spark, sf):
    """Tokens after the best cut of every run; the SQL tries all cuts."""
    rows = stable_copy(_as_ideographs(spark, sf).select("comment"))
    cut = G.corpus_tokenizer(rows, _SEGMENTS)
    tokens = rows.select(F.explode(cut(F.col("comment"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(O.base_scored(O.WORDS) + "SELECT item, word, y, x FROM bags")
def word_bags(spark, sf):
    return K.word_bags(scored(spark, sf), D.KEYWORDS)


def _log_odds(spark, sf):
    return K.log_odds(K.word_bags(scored(spark, sf), D.KEYWORDS), D.KEYWORDS)


@query(O.base_scored(O.WORDS, O.LOG_ODDS) + f"SELECT item, word, y, x, {_sql_r('z')} FROM z")
def log_odds(spark, sf):
    return _log_odds(spark, sf).select("item", "word", "y", "x", *_r("z"))


_TOPK = """top_words AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY z DESC, word) AS rank, 'pos' AS polarity FROM z0) WHERE rank <= 12
UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY z, word DESC) AS rank, 'neg' AS polarity FROM z0) WHERE rank <= 12)"""
_Z0 = "z0 AS (SELECT item, word, y, x, round(z, 3) AS z FROM z)"


def _top_words(spark, sf):
    """z is rounded to three digits first, as it is reported; equal z then go by word."""
    return K.top_keywords(stable_copy(_log_odds(spark, sf).withColumn("z", F.round("z", 3))), D.KEYWORDS)


@query(O.base_scored(O.WORDS, O.LOG_ODDS, _Z0, _TOPK) + "SELECT item, polarity, CAST(rank AS INT) AS rank, word, z, y, x FROM top_words")
def keywords_topk(spark, sf):
    return _top_words(spark, sf).select("item", "polarity", "rank", "word", "z", "y", "x")


@query(O.base_scored(O.WORDS, O.LOG_ODDS, _Z0, _TOPK) + """SELECT item, coalesce(string_agg(word, ' ' ORDER BY rank) FILTER (WHERE polarity = 'pos' AND rank <= 10), '') AS keywords_pos,
coalesce(string_agg(word, ' ' ORDER BY rank) FILTER (WHERE polarity = 'neg' AND rank <= 10), '') AS keywords_neg FROM top_words GROUP BY item""")
def keyword_lists(spark, sf):
    out = K.keyword_lists(_top_words(spark, sf), D.KEYWORDS)
    return out.select("item", _joined("keywords_pos"), _joined("keywords_neg"))


# --- item scores ------------------------------------------------------------------

_MEANS = ("model_pos_rate", "p_pos_mean", "pred_rating_mean", "star_mean", "likes_mean", "star_pos_rate")
_COUNTS = ("n_reviews", "star_pos", "star_neg", "star_mid", "model_pos", "model_neg")
_SCORES = ("bayes_rating", "rating_score", "sentiment_score", "final_score", "confidence")


@query(O.base_scored(O.STATS, source="uniq") + f"SELECT item, {', '.join(_COUNTS)}, star_sum, likes_sum, {_sql_r(*_MEANS)} FROM stats")
def item_stats(spark, sf):
    return R.item_stats(unique_scored(spark, sf)).select("item", *_COUNTS, "star_sum", "likes_sum", *_r(*_MEANS))


@query(O.base_scored(O.STATS, source="uniq") + f"SELECT item, n_reviews, {_sql_r(*_SCORES)} FROM scores")
def item_scoreboard(spark, sf):
    """The flagship: cleaned, deduplicated, scored and ranked items."""
    out = R.item_scores(R.item_stats(unique_scored(spark, sf)))
    return out.orderBy(F.desc("final_score"), "item").select("item", "n_reviews", *_r(*_SCORES))


_SUMMARY_SQL = """names AS (SELECT coalesce(p.item, c.item) AS item, coalesce(p.pros, '') AS pros, coalesce(c.cons, '') AS cons
  FROM (SELECT item, string_agg(aspect, '、' ORDER BY rank) AS pros FROM pros GROUP BY item) p
  FULL JOIN (SELECT item, string_agg(aspect, '、' ORDER BY rank) AS cons FROM cons GROUP BY item) c ON p.item = c.item),
board AS (SELECT s.*, coalesce(n.pros, '') AS pros, coalesce(n.cons, '') AS cons,
  coalesce(m.n_suspect, 0) AS n_suspect, coalesce(m.suspect_rate, 0) AS suspect_rate
  FROM scores s LEFT JOIN names n ON s.item = n.item LEFT JOIN summary m ON s.item = m.item)"""
_BOARD = (O.STATS, O.CLAUSES, O.HITS, O.RATES.replace("rates AS", "rates AS", 1), O.ASPECT_CHOICE, O.SPAM, O.SPAM_SUMMARY, _SUMMARY_SQL)


def _shared(spark, sf) -> DataFrame:
    """Cleaned and scored reviews, stored once for a query that reads them several times."""
    return stable_copy(scored(spark, sf))


def _pros_cons(rows: DataFrame) -> DataFrame:
    mentions = stable_copy(A.aspect_mentions(rows, clause_score, D.ASPECTS))
    table = stable_copy(A.aspect_table(mentions, D.ASPECTS))
    return A.pros_and_cons(table, rows, cfg=D.ASPECTS)


def _spam_base(spark, sf):
    return stable_copy(X.signal_base(scored(spark, sf), D.SPAM))


def _detail(spark, sf):
    return X.spam_detail(_spam_base(spark, sf), D.SPAM)


def _detail_of(rows: DataFrame) -> DataFrame:
    return X.spam_detail(stable_copy(X.signal_base(rows, D.SPAM)), D.SPAM)


def _board(rows: DataFrame, aspects: DataFrame) -> DataFrame:
    scores = R.item_scores(R.item_stats(rows))
    return R.item_summary(scores, aspects, X.spam_summary(_detail_of(rows)))


@query(O.base_scored(*_BOARD) + f"SELECT item, {', '.join(_COUNTS)}, likes_sum, {_sql_r('star_pos_rate', 'model_pos_rate', 'pred_rating_mean', 'star_mean', 'likes_mean', *_SCORES)}, pros, cons, n_suspect, {_sql_r('suspect_rate')} FROM board")
def item_summary(spark, sf):
    rows = _shared(spark, sf)
    return _board(rows, _pros_cons(rows)).select(
        "item", *_COUNTS, "likes_sum", *_r("star_pos_rate", "model_pos_rate", "pred_rating_mean", "star_mean", "likes_mean", *_SCORES),
        "pros", "cons", "n_suspect", *_r("suspect_rate"))


_PCT = lambda share: f"CAST(floor({share} * 100 + 0.5) AS BIGINT) || '%'"
_HEAD_LINES = f"""'score: ' || item || ' ' || printf('%.2f', final_score) || chr(10) ||
 'reviews by stars: ' || star_pos || ' good, ' || star_neg || ' bad, ' || star_mid || ' neutral, ' || n_reviews || ' in all (' || {_PCT('star_pos_rate')} || ' good)' || chr(10) ||
 'reviews by model: ' || model_pos || ' good, ' || model_neg || ' bad (' || {_PCT('model_pos_rate')} || ' good)'"""


@query(O.base_scored(O.STATS) + f"SELECT item, {_HEAD_LINES} AS block FROM scores")
def item_report(spark, sf):
    return sinks.report_blocks(R.item_scores(R.item_stats(scored(spark, sf)))).select("item", "block")


def _aspect_lines_sql(name: str, label: str, polarity: str) -> str:
    return f"""{name}_lines AS (SELECT l.item, '{label}: ' || string_agg(l.aspect || ' ' || l.mentions || ' (' || {_PCT('l.pos_rate')} || ')', ', ' ORDER BY l.rank)
  || coalesce(chr(10) || string_agg('  > ' || substring(e.clause, 1, 60), chr(10) ORDER BY l.rank) FILTER (WHERE l.rank <= 2 AND e.clause IS NOT NULL), '') AS lines
  FROM {name} l LEFT JOIN (SELECT * FROM evidence WHERE rank = 1 AND polarity = '{polarity}') e ON e.item = l.item AND e.aspect = l.aspect GROUP BY l.item)"""


_REPORT = ", ".join([O.EVIDENCE, _aspect_lines_sql("pros", "liked", "pos"), _aspect_lines_sql("cons", "disliked", "neg"), _aspect_lines_sql("weak", "weakest", "neg")])


@query(O.base_scored(*_BOARD, _REPORT) + f"""SELECT b.item, round(final_score, 6) AS final_score, {_HEAD_LINES.replace("|| item ||", "|| b.item ||")}
 || chr(10) || 'suspicious: ' || n_suspect || ' (' || {_PCT('suspect_rate')} || ')'
 || coalesce(chr(10) || p.lines, '') || coalesce(chr(10) || c.lines, '') || coalesce(chr(10) || w.lines, '') AS block
FROM board b LEFT JOIN pros_lines p ON p.item = b.item LEFT JOIN cons_lines c ON c.item = b.item LEFT JOIN weak_lines w ON w.item = b.item""")
def full_report(spark, sf):
    """Report blocks with suspects, aspects and quotes."""
    rows = _shared(spark, sf)
    aspects = stable_copy(_pros_cons(rows))
    return sinks.report_blocks(_board(rows, aspects), aspects).select("item", *_r("final_score"), "block")


# --- aggregates kept per segment ---------------------------------------------------

_STATES = Z.StateConfig(250, aspects=D.ASPECTS, keywords=D.KEYWORDS, spam=D.SPAM)
_CHANGED = """changed AS (SELECT * REPLACE (CASE WHEN row_id < 250 THEN 6 - star ELSE star END AS star)
  FROM scored WHERE row_id >= 250 OR row_id % 7 <> 0)"""


@query(O.base_scored(_CHANGED, O.STATS.replace("FROM scored", "FROM changed")) + f"SELECT item, {', '.join(_COUNTS)}, star_sum, likes_sum, {_sql_r(*_MEANS, 'final_score')} FROM scores")
def incremental_items(spark, sf):
    """States of all segments; the first segment changes, is computed again and replaced. The SQL
    runs over all of the changed rows."""
    rows, path = _shared(spark, sf), shared_folder(spark)
    Z.write_states(Z.item_states(rows, _STATES), path, _STATES)
    first = rows.filter("row_id < 250 AND row_id % 7 <> 0").withColumn("star", 6 - F.col("star"))
    Z.write_states(Z.item_states(first, _STATES), path, _STATES, 0, 250)
    scores = R.item_scores(Z.merged_items(Z.read_states(spark, path)))
    return scores.select("item", *_COUNTS, "star_sum", "likes_sum", *_r(*_MEANS, "final_score"))


_PAGE = f"""suspects AS (SELECT item, string_agg(CAST(row_id AS VARCHAR), ' ' ORDER BY rank) AS suspects FROM (SELECT item, row_id,
  row_number() OVER (PARTITION BY item ORDER BY spam_points DESC, likes DESC, row_id) AS rank FROM detail WHERE is_suspect) WHERE rank <= {D.SPAM.top_suspects} GROUP BY item),
word_lists AS (SELECT item, coalesce(string_agg(word, ' ' ORDER BY rank) FILTER (WHERE polarity = 'pos' AND rank <= 10), '') AS keywords_pos,
  coalesce(string_agg(word, ' ' ORDER BY rank) FILTER (WHERE polarity = 'neg' AND rank <= 10), '') AS keywords_neg FROM top_words GROUP BY item),
quotes AS (SELECT p.item, string_agg(e.clause, ' / ' ORDER BY p.rank, e.rank) AS quotes FROM pros p JOIN evidence e
  ON e.item = p.item AND e.aspect = p.aspect AND e.polarity = 'pos' WHERE e.rank <= {D.ASPECTS.evidence_shown} GROUP BY p.item)"""
_HITS = " || ' ' || ".join(f"'{k}=' || spam_{k}" for k in C.SIGNALS)


@query(O.base_scored(*_BOARD, O.EVIDENCE, O.WORDS, O.LOG_ODDS, _Z0, _TOPK, _PAGE) + f"""SELECT b.item, b.n_reviews, round(final_score, 6) AS final_score, pros, cons, coalesce(q.quotes, '') AS quotes,
  coalesce(w.keywords_pos, '') AS keywords_pos, coalesce(w.keywords_neg, '') AS keywords_neg, b.n_suspect, {_HITS} AS hits, coalesce(x.suspects, '') AS suspects
FROM board b JOIN summary m ON m.item = b.item LEFT JOIN quotes q ON q.item = b.item LEFT JOIN word_lists w ON w.item = b.item LEFT JOIN suspects x ON x.item = b.item""")
def item_pages(spark, sf):
    """Pages of all items with aspects, quotes, keywords, hit map and suspects, from states that
    were written in two ranges, the first of them twice."""
    rows, path = _shared(spark, sf), shared_folder(spark)
    mentions, detail = stable_copy(A.aspect_mentions(rows, clause_score, D.ASPECTS)), stable_copy(_detail_of(rows))
    last = (rows.agg(F.max("row_id")).first()[0] // 250 + 1) * 250
    for start, end in ((0, 500), (500, last), (0, 500)):
        part = [t.filter(F.col("row_id").between(start, end - 1)) for t in (rows, mentions, detail)]
        Z.write_all(*part, path, _STATES, start, end)
    page = Z.item_page(spark, path, cfg=_STATES)
    names = lambda c: F.coalesce(R.aspect_names(F.col(c)), F.lit("")).alias(c)
    quotes = F.array_join(F.flatten(F.transform("pros", lambda e: e["evidence"])), " / ")
    hits = F.array_join(F.array(*[F.concat(F.lit(f"{k}="), F.col("by_type")[k].cast("string")) for k in C.SIGNALS]), " ")
    return page.select(
        "item", "n_reviews", F.round("final_score", 6).alias("final_score"), names("pros"), names("cons"),
        F.coalesce(quotes, F.lit("")).alias("quotes"), _joined("keywords_pos"), _joined("keywords_neg"), "n_suspect", hits.alias("hits"),
        F.coalesce(F.array_join(F.transform("top_suspects", lambda e: e["row_id"].cast("string")), " "), F.lit("")).alias("suspects"))


# --- suspicious reviews -------------------------------------------------------------


@query(O.base_scored(O.SPAM) + "SELECT row_id, norm, template_key FROM detail")
def norm_text(spark, sf):
    n = T.normalize_text(F.col("comment"))
    return clean(spark, sf).select("row_id", n.alias("norm"), T.template_head(n, 12).alias("template_key"))


def _signal(name: str, *sizes: str):
    """One signal with the group sizes it rests on."""
    cols = ", ".join(["row_id", *sizes, name])

    def run(spark, sf):
        return _detail(spark, sf).select("row_id", *sizes, name)

    run.__name__ = f"signal_{name}"
    query(O.base_scored(O.SPAM) + f"SELECT {cols} FROM detail")(run)


def _base_query(name: str):
    """One row-local signal, straight from the scan."""

    def run(spark, sf):
        return X.signal_base(scored(spark, sf), D.SPAM).select("row_id", name)

    run.__name__ = f"signal_{name}"
    query(O.base_scored(O.SPAM) + f"SELECT row_id, {name} FROM detail")(run)


def _text_query(name: str, test: Callable[[], Column], *sizes: str):
    """One signal on text groups."""

    def run(spark, sf):
        base = _spam_base(spark, sf)
        return X.with_text_groups(base).select("row_id", *sizes, test().alias(name))

    run.__name__ = f"signal_{name}"
    query(O.base_scored(O.SPAM) + f"SELECT {', '.join(['row_id', *sizes, name])} FROM detail")(run)


def _user_query(name: str, test: Callable[[], Column], *sizes: str):
    """One signal on user groups."""

    def run(spark, sf):
        base = _spam_base(spark, sf)
        return X.with_user_groups(base).select("row_id", *sizes, test().alias(name))

    run.__name__ = f"signal_{name}"
    query(O.base_scored(O.SPAM) + f"SELECT {', '.join(['row_id', *sizes, name])} FROM detail")(run)


_text_query("dup_same_movie", lambda: F.col("dup_same_movie_size") >= 2, "dup_same_movie_size")
_text_query("dup_cross_movie", lambda: F.col("text_movie_count") >= 3, "text_movie_count", "text_total_count")
_text_query("template", lambda: F.col("template_size") >= 5, "template_size")
_base_query("ad")
_user_query("user_burst", lambda: F.col("user_movie_day_count") >= 2, "user_movie_day_count")
_user_query("user_repeat", lambda: F.col("user_movie_count") >= 3, "user_movie_count")
_signal("movie_day_burst", "movie_day_count", "day_burst_p999")
_base_query("rating_mismatch")
_base_query("like_bomb")
_base_query("low_info")

_EVENT_DAYS = "d AS (SELECT event_type AS item, CAST(ts AS DATE) AS day, count(*) AS movie_day_count FROM events GROUP BY ALL)"


def _event_base(spark, sf):
    return D.table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), F.col("event_type").alias("item"), "user_id",
        F.unix_date(F.to_date("ts")).alias("day_no"))


@query(f"WITH {_EVENT_DAYS}, f AS (SELECT movie_day_count FROM events JOIN d ON event_type = item AND CAST(ts AS DATE) = day), c AS (SELECT quantile_cont(movie_day_count, 0.9) AS cut FROM f) "
       "SELECT item, CAST(day - DATE '1970-01-01' AS INT) AS day_no, movie_day_count, round(cut, 6) AS cut, movie_day_count > cut AS burst FROM d, c")
def day_burst_rows(spark, sf):
    """Bursts among event days; the quantile weighs each day by its rows."""
    base = _event_base(spark, sf)
    cut = X.day_cut(base, C.SpamConfig(day_quantile=0.9)).scalar()
    days = X.item_days(base).withColumn("cut", cut)
    return days.select("item", "day_no", "movie_day_count", *_r("cut"), (F.col("movie_day_count") > F.col("cut")).alias("burst"))


@query(f"WITH {_EVENT_DAYS}, c AS (SELECT quantile_cont(movie_day_count, 0.99) AS cut FROM d) "
       "SELECT item, CAST(day - DATE '1970-01-01' AS INT) AS day_no, movie_day_count, round(cut, 6) AS cut, movie_day_count > cut AS burst FROM d, c")
def day_burst_days(spark, sf):
    """Bursts among event days; the quantile counts each day once."""
    base = _event_base(spark, sf)
    cut = X.day_cut(base, C.SpamConfig(day_quantile=0.99, day_over="days")).scalar()
    days = X.item_days(base).withColumn("cut", cut)
    return days.select("item", "day_no", "movie_day_count", *_r("cut"), (F.col("movie_day_count") > F.col("cut")).alias("burst"))


@query(O.base_scored(O.SPAM) + "SELECT row_id, user_id, day_no AS day, user_total, user_movie_count, user_movie_day_count, movie_day_count FROM detail")
def user_features(spark, sf):
    return X.user_features(_spam_base(spark, sf))


@query(O.base_scored(O.SPAM) + f"SELECT row_id, item, {', '.join(C.SIGNALS)}, CAST(spam_points AS INT) AS spam_points, spam_score, is_suspect, reasons, dup_same_movie_size, text_total_count, text_movie_count, template_size FROM detail")
def spam_detail(spark, sf):
    return _detail(spark, sf).withColumn("reasons", X.reasons_text(F.col("reasons"))).select(
        "row_id", "item", *C.SIGNALS, "spam_points", "spam_score", "is_suspect", "reasons",
        "dup_same_movie_size", "text_total_count", "text_movie_count", "template_size")


@query(O.base_scored(O.SPAM) + "SELECT reasons, count(*) AS n FROM detail GROUP BY reasons")
def spam_reasons(spark, sf):
    return _detail(spark, sf).groupBy(X.reasons_text(F.col("reasons")).alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


_HITS = [f"spam_{s}" for s in C.SIGNALS]


@query(O.base_scored(O.SPAM, O.SPAM_SUMMARY) + f"SELECT item, n_reviews, n_suspect, {_sql_r('suspect_rate', 'mean_spam_score', 'day_burst_p999')}, {', '.join(_HITS)} FROM summary")
def spam_summary(spark, sf):
    out = X.spam_summary(_detail(spark, sf))
    return out.select("item", "n_reviews", "n_suspect", *_r("suspect_rate", "mean_spam_score", "day_burst_p999"), *_HITS)


@query(O.base_scored(O.SPAM) + """SELECT item, CAST(rank AS INT) AS rank, row_id, star, likes, spam_score, reasons, substring(comment, 1, 80) AS comment FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY spam_points DESC, likes DESC, row_id) AS rank FROM detail WHERE is_suspect) WHERE rank <= 8""")
def spam_top8(spark, sf):
    """The suspects meet the raw table, so only their texts are cleaned."""
    ranked = stable_copy(X.rank_suspects(_detail(spark, sf), D.SPAM))
    raw = D.reviews(spark, sf).join(ranked.select("row_id"), "row_id", "left_semi")
    out = X.suspect_texts(ranked, N.clean_reviews(raw), D.SPAM)
    return out.select("item", "rank", "row_id", "star", "likes", "spam_score", X.reasons_text(F.col("reasons")).alias("reasons"), "comment")


_UNPIVOT = " UNION ALL ".join(f"SELECT item, '{s}' AS signal, spam_{s} AS hits FROM summary" for s in C.SIGNALS)


@query(O.base_scored(O.SPAM, O.SPAM_SUMMARY) + f"SELECT item, CAST(rank AS INT) AS rank, signal, hits FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY hits DESC, signal) AS rank FROM ({_UNPIVOT})) WHERE rank <= 3")
def spam_signal_rank(spark, sf):
    return X.signal_ranking(X.spam_summary(_detail(spark, sf))).select("item", "rank", "signal", "hits")


@query(O.base_scored(O.SPAM, O.SPAM_SUMMARY) + "SELECT CAST(sum(n_suspect) AS BIGINT) AS n_suspect, CAST(sum(n_reviews) AS BIGINT) AS n_reviews, round(sum(n_suspect) / sum(n_reviews)::DOUBLE, 6) AS suspect_rate FROM summary")
def spam_totals(spark, sf):
    return X.site_totals(X.spam_summary(_detail(spark, sf))).select("n_suspect", "n_reviews", *_r("suspect_rate"))


@query(O.base_scored(O.SPAM, O.SPAM_SUMMARY) + "SELECT item, n_reviews, n_suspect, round(suspect_rate, 6) AS suspect_rate FROM summary ORDER BY summary.suspect_rate DESC, item LIMIT 8")
def spam_ranked_items(spark, sf):
    return X.most_suspect_items(X.spam_summary(_detail(spark, sf))).select("item", "n_reviews", "n_suspect", *_r("suspect_rate"))


@query(O.base_scored(O.SPAM, O.SPAM_SUMMARY) + """, t AS (SELECT item, count(*) AS n_top FROM (
  SELECT item, row_number() OVER (PARTITION BY item ORDER BY spam_points DESC, likes DESC, row_id) AS rank FROM detail WHERE is_suspect) WHERE rank <= 8 GROUP BY item)
SELECT s.item, n_suspect, spam_ad AS ad, spam_template AS template, spam_low_info AS low_info, coalesce(n_top, 0) AS n_top FROM summary s LEFT JOIN t ON s.item = t.item""")
def spam_nested_json(spark, sf):
    """Nested summary written as JSON and read back with its schema."""
    rows = _shared(spark, sf)
    detail = stable_copy(_detail_of(rows))
    top = X.suspect_texts(X.rank_suspects(detail, D.SPAM), rows, D.SPAM)
    nested = X.nested_spam_summary(X.spam_summary(detail), top)
    path = shared_folder(spark) + "/spam_json"
    sinks.write_json(nested, path)
    back = spark.read.schema(nested.schema).json(path)
    return back.select(
        "item", "n_suspect", *[F.col("by_type")[s].alias(s) for s in ("ad", "template", "low_info")],
        F.coalesce(F.size("top_suspects"), F.lit(0)).cast("bigint").alias("n_top"))


# --- reads ------------------------------------------------------------------------


@query(O.base_scored(O.STATS) + "SELECT item, round(final_score, 6) AS final_score FROM scores ORDER BY scores.final_score DESC, item LIMIT 10")
def leaderboard(spark, sf):
    return V.leaderboard(R.item_scores(R.item_stats(scored(spark, sf)))).select("item", *_r("final_score"))


@query(O.base_scored(*_BOARD) + f"SELECT item, n_reviews, {_sql_r('final_score', 'suspect_rate')}, replace(pros, '、', ',') AS pros, replace(cons, '、', ',') AS cons FROM board")
def item_list(spark, sf):
    rows = _shared(spark, sf)
    summary = R.item_summary(R.item_scores(R.item_stats(rows)), _pros_cons(rows))
    out = V.list_items(summary, X.spam_summary(_detail_of(rows)))
    return out.select("item", "n_reviews", *_r("final_score", "suspect_rate"), _joined("pros", ","), _joined("cons", ","))


@query(O.base_scored(*_BOARD) + f"""SELECT board.item, board.n_reviews, {_sql_r('final_score')}, board.n_suspect, pros, cons,
  coalesce((SELECT string_agg(aspect, '、' ORDER BY rank) FROM weak WHERE weak.item = board.item), '') AS weak FROM board WHERE board.item = 'src3'""")
def item_detail(spark, sf):
    rows = _shared(spark, sf)
    details = V.item_details(R.item_scores(R.item_stats(rows)), _pros_cons(rows), X.spam_summary(_detail_of(rows)))
    names = lambda c: R.aspect_names(F.col(c)).alias(c)
    return V.item_detail(details, "src3").select(
        "item", F.col("stats.n_reviews").alias("n_reviews"), F.round("score.final_score", 6).alias("final_score"),
        F.col("spam.n_suspect").alias("n_suspect"), names("pros"), names("cons"), names("weak"))


@query(O.base(O.CLAUSES, O.HITS, O.RATES) + f"SELECT aspect, mentions, {_sql_r('pos_rate', 'like_weighted_pos_rate')} FROM rates WHERE item = 'src3'")
def item_aspects(spark, sf):
    return V.item_aspects(_rates(spark, sf), "src3").select("aspect", "mentions", *_r("pos_rate", "like_weighted_pos_rate"))


@query(O.base_scored() + """SELECT row_id, md5(comment) AS digest, star, likes, p_pos, round(exp_rating, 6) AS pred_rating FROM scored
WHERE item = 'src3' AND pred_sent = 0 ORDER BY p_pos, row_id LIMIT 20""")
def sample_reviews(spark, sf):
    rows = scored(spark, sf)
    out = V.sample_reviews(rows, rows.select("row_id", "item", "comment", "star", "likes"), "src3", "neg", 20)
    return out.select("row_id", F.md5("comment").alias("digest"), "star", "likes", "p_pos", *_r("pred_rating"))


@query(O.base_scored() + """SELECT item, CAST(rank AS INT) AS rank, row_id, star, likes, p_pos, round(exp_rating, 6) AS pred_rating FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY p_pos DESC, row_id) AS rank FROM scored WHERE pred_sent = 1) WHERE rank <= 20""")
def sample_reviews_all(spark, sf):
    out = V.sample_reviews_all(scored(spark, sf))
    return out.select("item", "rank", "row_id", "star", "likes", "p_pos", *_r("pred_rating"))


@query(O.base_scored(O.SPAM, O.SPAM_SUMMARY) + f"SELECT item, n_reviews, n_suspect, {_sql_r('suspect_rate', 'mean_spam_score')} FROM summary WHERE item = 'src3'")
def item_spam(spark, sf):
    out = V.item_spam(X.spam_summary(_detail(spark, sf)), "src3")
    return out.select("item", "n_reviews", "n_suspect", *_r("suspect_rate", "mean_spam_score"))


@query(O.base_scored(O.STATS) + """SELECT item, kind, n, round(n / n_reviews::DOUBLE, 6) AS share FROM (
  SELECT item, 'good' AS kind, star_pos AS n, n_reviews FROM stats UNION ALL SELECT item, 'neutral', star_mid, n_reviews FROM stats
  UNION ALL SELECT item, 'bad', star_neg, n_reviews FROM stats)""")
def star_distribution(spark, sf):
    return V.star_distribution(R.item_stats(scored(spark, sf))).select("item", "kind", "n", *_r("share"))


@query(O.base_scored(O.STATS) + """SELECT item, kind, n, round(n / n_reviews::DOUBLE, 6) AS share FROM (
  SELECT item, 'good' AS kind, model_pos AS n, n_reviews FROM stats UNION ALL SELECT item, 'bad', model_neg, n_reviews FROM stats)""")
def verdict_distribution(spark, sf):
    return V.verdict_distribution(R.item_stats(scored(spark, sf))).select("item", "kind", "n", *_r("share"))


# --- checks -----------------------------------------------------------------------

_CHECKS = {
    "final_score_range": ("required", "SELECT count(*) FROM scores WHERE NOT final_score BETWEEN 0 AND 10"),
    "bayes_rating_range": ("required", "SELECT count(*) FROM scores WHERE NOT bayes_rating BETWEEN 1 AND 5"),
    "confidence_range": ("required", "SELECT count(*) FROM scores WHERE NOT confidence BETWEEN 0 AND 1"),
    "stars_add_up": ("required", "SELECT count(*) FROM scores WHERE star_pos + star_neg + star_mid <> n_reviews"),
    "verdicts_add_up": ("required", "SELECT count(*) FROM scores WHERE model_pos + model_neg <> n_reviews"),
    "enough_reviews": ("required", "SELECT count(*) FROM scores WHERE n_reviews < 1000"),
    "p_pos_range": ("required", "SELECT count(*) FROM scored WHERE NOT p_pos BETWEEN 0 AND 1"),
    "pred_sent_values": ("required", "SELECT count(*) FROM scored WHERE pred_sent NOT IN (0, 1)"),
    "exp_rating_range": ("warning", "SELECT count(*) FROM scored WHERE NOT exp_rating BETWEEN 1 AND 5"),
    "verdict_follows_threshold": ("warning", "SELECT count(*) FROM scored WHERE (p_pos >= 0.5)::INT <> pred_sent"),
    "row_id_unique": ("required", "SELECT count(*) - count(DISTINCT row_id) FROM scored"),
    "row_id_dense": ("required", "SELECT abs(max(row_id) - min(row_id) + 1 - count(DISTINCT row_id)) + abs(min(row_id)) FROM scored"),
    "suspect_rate_range": ("required", "SELECT count(*) FROM summary WHERE NOT suspect_rate BETWEEN 0 AND 1"),
    "suspects_within_reviews": ("required", "SELECT count(*) FROM summary WHERE n_suspect > n_reviews"),
    "every_item_has_suspects": ("required", "SELECT count(*) FROM summary WHERE n_suspect = 0"),
    "suspects_have_reasons": ("required", "SELECT count(*) FROM detail WHERE is_suspect AND reasons = ''"),
    "spam_score_range": ("required", "SELECT count(*) FROM detail WHERE NOT spam_score BETWEEN 0 AND 1"),
    "has_pros": ("required", "SELECT count(*) FROM (SELECT DISTINCT item FROM rates) WHERE item NOT IN (SELECT item FROM pros)"),
    "has_cons_or_weak": ("required", "SELECT count(*) FROM (SELECT DISTINCT item FROM rates) WHERE item NOT IN (SELECT item FROM cons UNION SELECT item FROM weak)"),
    "evidence_not_blank": ("required", "SELECT count(*) FROM mentions WHERE clause = ''"),
    "totals_match": ("required", "SELECT count(*) FROM scores s FULL JOIN summary m ON s.item = m.item WHERE s.n_reviews IS DISTINCT FROM m.n_reviews"),
}


def _checks_table(spark, sf):
    rows = _shared(spark, sf)
    scores = stable_copy(R.item_scores(R.item_stats(rows)))
    detail = stable_copy(_detail_of(rows))
    per_item = stable_copy(X.spam_summary(detail))
    return Q.all_checks(
        Q.summary_checks(scores), Q.prediction_checks(rows), Q.spam_checks(per_item, detail),
        Q.aspect_checks(_pros_cons(rows)), Q.totals_check(scores, per_item))


@query(O.base_scored(*_BOARD) + "SELECT \"check\", level, violations, violations = 0 AS ok FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS \"check\", '{lvl}' AS level, CAST(({sql}) AS BIGINT) AS violations" for n, (lvl, sql) in _CHECKS.items()) + ")")
def quality_checks(spark, sf):
    return _checks_table(spark, sf)


_GATES = {
    "accuracy": "NOT acc > 0.80", "f1_good": "NOT f1_pos > 0.85", "rating_mae": "NOT (SELECT avg(abs(pred_rating - star)) FROM scored) < 0.8",
    "threshold": "NOT (threshold > 0.05 AND threshold < 0.95)",
}


@query(O.base_scored(_EVAL, _STEPS, _CAL.split("\nSELECT")[0], "cal AS (SELECT" + _CAL.split("\nSELECT")[1] + ")") + " UNION ALL ".join(
    f"SELECT '{n}' AS \"check\", 'required' AS level, ({sql})::BIGINT AS violations, NOT ({sql}) AS ok FROM cal" for n, sql in _GATES.items()))
def metric_gates(spark, sf):
    """Gates on the calibrated metrics; the word-list scorer is not expected to pass them all."""
    rows = _eval(spark, sf)
    mae = E.rating_error(rows).select("rating_mae").scalar()
    return Q.metric_gates(E.calibrate(rows).withColumn("rating_mae", mae))


# --- streams and their batch twins ----------------------------------------------------


@query("SELECT event_type AS item, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def event_day_volume(spark, sf):
    return D.events(spark, sf).groupBy(F.col("event_type").alias("item"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type AS item, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 3")
def event_user_burst(spark, sf):
    rows = D.events(spark, sf).withColumnRenamed("event_type", "item")
    counts = rows.groupBy("user_id", "item", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= 3)


@query("SELECT min(event_id) AS event_id, event_type, user_id, value FROM events GROUP BY event_type, user_id, value")
def event_dedup(spark, sf):
    rows = D.events(spark, sf).select("event_id", "event_type", "user_id", "value")
    kept = N.dedup_keep_first(
        rows.withColumn("text", F.col("value").cast("string")), ("event_type", "user_id"), "text", "event_id")
    return kept.drop("text")


def _event_stream(spark, sf):
    rows = jobs.read_table_stream(spark, f"{sf}/events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("event_type", "item")


def _run_stream(spark, df: DataFrame) -> DataFrame:
    folder = shared_folder(spark)
    jobs.write_stream(df, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query(ORACLES["event_dedup"])
def event_dedup_batches(spark, sf):
    """The same rows from three batches of a stream that is started three times; every batch brings
    all events of the earlier ones again."""
    folder = shared_folder(spark)
    rows = stable_copy(D.events(spark, sf).select("event_id", "event_type", "user_id", F.col("value").cast("string").alias("value")))
    last = rows.agg(F.max("event_id").alias("m")).scalar()
    for k in (1, 2, 3):
        rows.filter(F.col("event_id") * 3 <= last * k).write.mode("append").parquet(f"{folder}/in")
        reader = jobs.read_stream(spark, f"{folder}/in", rows.schema)
        seen.unseen_stream(reader, folder, f"{folder}/checkpoint", ["event_type", "user_id"], "value", "event_id").awaitTermination()
    return seen.kept_rows(spark, folder).select("event_id", "event_type", "user_id", F.col("value").cast("double").alias("value"))


@query("SELECT DISTINCT event_type AS item, user_id, value FROM events")
def stream_dedup(spark, sf):
    """The keys that pass; which of several equal events does is a matter of arrival."""
    kept = _run_stream(spark, jobs.dedup_stream(_event_stream(spark, sf), ["item", "user_id", "value"], None))
    return kept.select("item", "user_id", "value")


def _run_counts(spark, df: DataFrame, keys: list[str]) -> DataFrame:
    folder = shared_folder(spark)
    jobs.write_updates(df, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return jobs.latest_counts(spark, f"{folder}/out", df.schema, keys)


@query("SELECT event_type AS item, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_day_volume(spark, sf):
    """Counts by updates, so that the last days are there as well."""
    return _run_counts(spark, jobs.day_volume_stream(_event_stream(spark, sf)), ["item", "day"])


@query("SELECT user_id, event_type AS item, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 3")
def stream_burst(spark, sf):
    bursts = jobs.burst_stream(_event_stream(spark, sf), ["user_id", "item"], 3)
    return _run_counts(spark, bursts, ["user_id", "item", "day"])


@query("WITH " + O.REVIEWS + f", every AS (SELECT row_id, star, {O.cleaned('comment')} AS comment FROM reviews), " + O.scored("every")
       + f" SELECT row_id, p_pos, pred_sent, {_sql_r('exp_rating')}, pred_rating, {_sql_r('p_rating')} FROM scored")
def stream_scores(spark, sf):
    folder = shared_folder(spark)
    docs = jobs.read_table_stream(spark, f"{sf}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("row_id"), T.clean_text(F.col("text")).alias("comment"))
    score = lambda df: M.attach_lexicon_scores(df, D.SENTIMENT).drop("comment")
    jobs.score_stream(rows, score, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("row_id", "p_pos", "pred_sent", *_r("exp_rating"), "pred_rating", *_r("p_rating"))


# --- sketches, levels of detail, runs and late predictions --------------------------


@query("WITH " + O.REVIEWS + """, r AS (SELECT *, length(comment) AS n FROM reviews)
SELECT count(*) AS n_rows, count(*) FILTER (coalesce(n, 0) = 0) AS empty_comment, round(avg(n), 6) AS len_mean, max(n) AS len_max,
  count(DISTINCT user_id) + CAST(count(*) > count(user_id) AS INT) AS exact_users,
  (SELECT count(*) FROM (SELECT DISTINCT item, day_no FROM r)) AS exact_item_days,
  (SELECT count(*) FROM (SELECT DISTINCT comment FROM r)) AS exact_texts,
  (SELECT count(*) FROM (SELECT DISTINCT item, user_id, comment FROM r)) AS exact_reviews,
  true AS users_ok, true AS item_days_ok, true AS texts_ok, true AS reviews_ok, true AS len_p50_ok, true AS len_p90_ok, true AS len_p99_ok
FROM r""")
def profile_sketches(spark, sf):
    """States of old segments, then of new ones and of one that is written again; the estimates
    that are merged from them are held against the exact figures."""
    cfg = H.SketchConfig(rows_per_segment=250)
    states = Z.StateConfig(rows_per_segment=250)
    path = shared_folder(spark) + "/profile"
    rows = D.reviews(spark, sf)
    Z.write_states(H.profile_states(rows.filter("row_id < 500").withColumn("comment", F.lit("old")), cfg), path, states)
    Z.write_states(H.profile_states(rows.filter("row_id < 500"), cfg), path, states, 0, 500)
    H.profile_states(rows.filter("row_id >= 500"), cfg).write.mode("append").partitionBy("segment").parquet(path)
    profile = stable_copy(H.merged_profile(Z.read_states(spark, path)))
    out = H.errors_within(profile, rows, cfg)
    return out.withColumn("len_mean", F.round("len_mean", 6))


@query(O.base_scored() + """SELECT item, star, pred_sent, CAST(grouping(item, star, pred_sent) AS BIGINT) AS grouping_id, count(*) AS n,
  CAST(sum(likes) AS BIGINT) AS likes_sum, round(sum(p_pos), 6) AS p_pos_sum
FROM scored GROUP BY GROUPING SETS ((item), (), (item, star), (item, pred_sent), (star), (pred_sent))""")
def review_cube(spark, sf):
    out = U.review_cube(scored(spark, sf))
    return out.withColumn("p_pos_sum", F.round("p_pos_sum", 6))


@query(O.base_scored() + """SELECT item, star, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY item), 6) AS share FROM scored GROUP BY item, star""")
def star_shares(spark, sf):
    return U.shares(U.review_cube(scored(spark, sf)), "star").select("item", "star", "n", *_r("share"))


_RUNS = """marked AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
placed AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM marked),
runs AS (SELECT user_id, event_type AS item, min(ts) AS first, max(ts) AS last, count(*) AS n FROM placed GROUP BY user_id, event_type, run HAVING count(*) >= 2)"""


def _as_text(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "item", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("first", "last")], "n")


_RUN_ROW = "user_id, item, strftime(first, '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(last, '%Y-%m-%d %H:%M:%S.%f') AS last, n"


@query(f"WITH {_RUNS} SELECT {_RUN_ROW} FROM runs")
def burst_sessions(spark, sf):
    """Runs of events of a user and type, over midnight or not."""
    rows = D.events(spark, sf).withColumnRenamed("event_type", "item")
    return _as_text(jobs.burst_sessions(rows, ["user_id", "item"], "12 hours", 2))


@query(f"WITH {_RUNS} SELECT {_RUN_ROW} FROM runs WHERE last + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_burst_sessions(spark, sf):
    """The same runs from a stream, as far as its watermark has closed them."""
    return _as_text(_run_stream(spark, jobs.burst_sessions(_event_stream(spark, sf), ["user_id", "item"], "12 hours", 2)))


_LATE = f"""e AS (SELECT event_id AS row_id, CAST(event_id % 5 + 1 AS INT) AS star, ts,
  CAST((event_id * 7919) % 100 AS DOUBLE) / 100 AS p, ts + to_hours(CAST((event_id * 31) % 40 AS BIGINT)) AS scored_ts FROM events),
met AS (SELECT row_id, star, ts, CASE WHEN scored_ts <= ts + INTERVAL 24 HOUR THEN p END AS p_pos FROM e),
flagged AS (SELECT row_id, star, ts, p_pos, CASE WHEN p_pos IS NOT NULL THEN (p_pos >= {C.SpamConfig().confident_positive} AND star <= 2) OR (p_pos <= {C.SpamConfig().confident_negative} AND star >= 4) END AS rating_mismatch FROM met)"""


def _late_inputs(spark, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events as reviews, and predictions for them that come up to 39 hours later."""
    reviews = rows.select(F.col("event_id").alias("row_id"), (F.col("event_id") % 5 + 1).cast("int").alias("star"), "ts")
    late = F.make_dt_interval(hours=((F.col("event_id") * 31) % 40).cast("int"))
    p = ((F.col("event_id") * 7919) % 100).cast("double") / 100
    return reviews, rows.select(F.col("event_id").alias("row_id"), p.alias("p_pos"), (F.col("ts") + late).alias("scored_ts"))


@query(f"WITH {_LATE} SELECT row_id, star, p_pos, rating_mismatch FROM flagged")
def late_predictions(spark, sf):
    found = jobs.late_predictions(*_late_inputs(spark, D.events(spark, sf)), "24 hours")
    return found.select("row_id", "star", "p_pos", "rating_mismatch")


@query(f"WITH {_LATE} SELECT row_id, star, p_pos, rating_mismatch FROM flagged WHERE p_pos IS NOT NULL OR ts + INTERVAL 24 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_late_predictions(spark, sf):
    """The same flags from two streams; a review without a prediction appears when it is certain."""
    reviews, _ = _late_inputs(spark, _event_stream(spark, sf))
    _, predictions = _late_inputs(spark, _event_stream(spark, sf))
    found = jobs.late_predictions(reviews, predictions, "24 hours", "1 day")
    return _run_stream(spark, found.select("row_id", "star", "p_pos", "rating_mismatch"))


# --- written tables, optional sides and refused arguments ---------------------------


@query(O.base() + "SELECT row_id, item, user_id, day_no, star, likes, comment FROM clean")
def parquet_sink(spark, sf):
    """Clean reviews written in a folder per item, and read back with a fixed schema."""
    path = shared_folder(spark) + "/clean"
    rows = clean(spark, sf).select("row_id", "item", "user_id", "day_no", "star", "likes", "comment")
    sinks.write_table(rows, path, ["item"])
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


_MARKED = "marked AS (SELECT item, count(*) FILTER (likes >= 300) AS n_suspect, count(*) FILTER (likes >= 300) / count(*) AS suspect_rate FROM scored WHERE item <> 'src3' GROUP BY item)"


@query(O.base_scored(O.STATS, _MARKED) + """SELECT 'with' AS side, s.item, n_reviews, coalesce(n_suspect, 0) AS n_suspect, round(coalesce(suspect_rate, 0), 6) AS suspect_rate
FROM scores s LEFT JOIN marked m ON s.item = m.item UNION ALL SELECT 'without', item, n_reviews, NULL, NULL FROM scores""")
def optional_side_table(spark, sf):
    """The summary with a side table that lacks one item, and without the table, before it is there."""
    path = shared_folder(spark) + "/marked"
    rows = stable_copy(scored(spark, sf).drop("comment"))
    scores = R.item_scores(R.item_stats(rows))
    bare = R.item_summary(scores, spam_summary=readers.read_optional(spark, path)).select(
        F.lit("without").alias("side"), "item", "n_reviews", F.lit(None).cast("bigint").alias("n_suspect"), F.lit(None).cast("double").alias("suspect_rate"))
    hits = F.count_if(F.col("likes") >= 300)
    side = rows.filter("item <> 'src3'").groupBy("item").agg(hits.alias("n_suspect"), (hits / F.count(F.lit(1))).alias("suspect_rate"))
    sinks.write_table(side, path)
    full = R.item_summary(scores, spam_summary=readers.read_optional(spark, path))
    return full.select(F.lit("with").alias("side"), "item", "n_reviews", "n_suspect", *_r("suspect_rate")).unionByName(bare)


@query(ORACLES["calibration_record"])
def metrics_file(spark, sf):
    """The calibration record written as a JSON file and read back with its schema."""
    path = shared_folder(spark) + "/metrics"
    record = QUERIES["calibration_record"](spark, sf)
    sinks.write_json(record, path)
    return spark.read.schema(record.schema).json(path)


@query(O.base_scored() + """SELECT 'known item' AS request, count(*) AS n, false AS refused FROM (SELECT * FROM scored WHERE item = 'src3' AND pred_sent = 1 LIMIT 20)
UNION ALL SELECT 'unknown item', 0, false UNION ALL SELECT 'bad polarity', NULL, true UNION ALL SELECT 'empty text', NULL, true""")
def bad_requests(spark, sf):
    """An unknown item gives no rows; a wrong polarity and an empty text are refused."""
    rows = scored(spark, sf)

    def refused(call) -> bool:
        try:
            call()
        except ValueError:
            return True
        return False

    def found(name: str, item: str) -> DataFrame:
        return V.sample_reviews(rows, rows, item).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("request"), "n", F.lit(False).alias("refused"))

    wrong = [("bad polarity", refused(lambda: V.sample_reviews(rows, rows, "src3", "both"))),
             ("empty text", refused(lambda: M.predict_text(spark, "  ", lambda df: M.attach_lexicon_scores(df, D.SENTIMENT))))]
    answers = spark.createDataFrame([(r, None, x) for r, x in wrong], "request string, n bigint, refused boolean")
    return found("known item", "src3").unionByName(found("unknown item", "no such item")).unionByName(answers)
