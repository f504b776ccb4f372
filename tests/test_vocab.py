import pytest
from pyspark.sql import functions as F

from plaudit import config as C
from plaudit.operators import vocab as B


@pytest.fixture(scope="module")
def vocab(spark):
    texts = ["灯光柔和配乐动人", "节奏明快", "平平无奇", "柔柔柔", "🎬"]
    df = spark.createDataFrame([(t,) for t in texts], "comment string")
    return B.build_vocab(df, C.SequenceConfig(min_freq=1)).cache()


def _ids(vocab):
    return {r.token: r.id for r in vocab.collect()}


def test_vocab_order_and_cap(spark):
    texts = spark.createDataFrame([(t,) for t in ("云云云", "云海", "雾", "山雾", "kk", "mmm")], "comment string")
    forced = B.forced_tokens()

    def tokens(**settings):
        return [r.token for r in B.build_vocab(texts, C.SequenceConfig(**settings)).orderBy("id").collect()]

    assert forced[:4] == ["<pad>", "<bos>", "<eos>", "<unk>"]
    assert tokens(min_freq=1) == [*forced, "云", "m", "k", "雾", "山", "海"]
    assert tokens(min_freq=2) == [*forced, "云", "m", "k", "雾"]
    assert tokens(min_freq=1, vocab_size=len(forced) + 1) == [*forced, "云"]


def test_encode_with_unknown_and_emoji(spark, vocab):
    ids = _ids(vocab)
    df = spark.createDataFrame([("光Q🎬",), ("",)], "comment string")
    got = [r.ids for r in B.encode_column(df, vocab).collect()]
    assert sorted(got, key=len) == [[], [ids["光"], C.UNK_ID, ids["🎬"]]]


def test_supervised_sequence(spark, vocab):
    ids, long_text = _ids(vocab), "灯光" * 90
    df = spark.createDataFrame([("节奏明快", 4), ("平平无奇", 3), (long_text, 2)], "comment string, star int")
    made = {r.star: r for r in B.encode_supervised(df, vocab).collect()}
    prompts = {r.comment: r.ids for r in B.encode_prompts(df, vocab).collect()}
    answers = {star: [x for x in r.labels if x != C.IGNORE_LABEL] for star, r in made.items()}
    assert answers == {4: [ids["好"], ids["4"], C.EOS_ID], 3: [ids["3"], C.EOS_ID], 2: [ids["差"], ids["2"], C.EOS_ID]}
    for r in made.values():
        assert len(r.ids) == len(r.labels) and r.ids[0] == C.BOS_ID and r.ids[-1] == r.labels[-1] == C.EOS_ID
        assert all(label in (C.IGNORE_LABEL, token) for token, label in zip(r.ids, r.labels))
    start = prompts["节奏明快"]
    assert made[4].ids[: len(start)] == start and start[-1] == ids["："]
    assert len(made[2].ids) == len(prompts[long_text]) == C.SequenceConfig().max_len


def test_batch_plan_and_padding(spark):
    lengths = [5, 17, 33, 34, 90, 100, 143, 12, 77, 160] * 5
    df = spark.createDataFrame([(n,) for n in lengths], "n int").select(F.array_repeat(F.lit(4), F.col("n")).alias("ids"))
    plan = B.batch_plan(df, C.BatchConfig(batch_size=6, min_batch=3)).collect()
    assert sum(r.n_rows for r in plan) == 50 and {r.batch_size for r in plan} == {6}
    assert {r.bucket: r.batches for r in plan} == {1: 2, 2: 1, 3: 2, 5: 1, 6: 1, 7: 1, 9: 1, 10: 1}
    assert B.batch_plan(df.filter(F.size("ids") == 100)).first().batch_size == 73  # 8,192 tokens of width 112
    keyed = df.withColumn("b", F.ceil(F.size("ids") / 16))
    for r in B.pad_sequences(keyed, ["b"]).collect():
        assert len(r.padded) == r.width == r.b * 16
        assert r.padded[len(r.ids):] == [C.PAD_ID] * (r.width - len(r.ids))


def test_batches_as_rows(spark):
    """Nine sequences of one bucket, four to a batch, and one of the next; ties go by id."""
    lengths = [5, 3, 3, 7, 2, 8, 1, 6, 4, 9]
    rows = spark.createDataFrame([(i, [1] * n) for i, n in enumerate(lengths)], "row_id long, ids array<int>")
    cfg = C.BatchConfig(batch_size=4, token_budget=1000, bucket_width=8, min_batch=1)
    got = {r.row_id: (r.batch, r.slot) for r in B.batched_sequences(rows, cfg).collect()}
    assert [got[i] for i in (6, 4, 1, 2)] == [(0, 0), (0, 1), (0, 2), (0, 3)]
    assert [got[i] for i in (8, 0, 7, 3)] == [(1, 0), (1, 1), (1, 2), (1, 3)]
    assert got[5] == (2, 0) and got[9] == (3, 0)
    assert B.batched_sequences(rows.filter("false"), cfg).count() == 0


def test_batches_read_the_sequences_once(spark):
    """F16: the sequences were made three times, for the plan, the range sort's sample and the sort."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def ids(n):
        seen.add(1)
        return [1] * (n % 40)

    rows = spark.range(300).select(F.col("id").alias("row_id"), ids("id").alias("ids"))
    assert B.batched_sequences(rows).count() == 300 and seen.value == 300
