from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from cases import LONG, edge_docs, no_docs

from plaudit.llm import mixing as M

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutations(n):
    for key in (1, 2):
        assert sorted(M.permuted(np.arange(n), n, key)) == list(range(n))
    if n > 60:
        assert (M.permuted(np.arange(n), n, 1) != M.permuted(np.arange(n), n, 2)).any()


def test_targets():
    sizes = pd.DataFrame({"source": [None, "b", "a", "é", "c"], "size": [10, 1000, 100, 1000, 0]})
    got = M.source_targets(sizes)
    assert got["source"].tolist() == ["a", "b", "c", "é", None]
    assert got["weight"].tolist() == [1, 2, 3, 1, 2]
    by = dict(zip(got["source"], got["target"]))
    assert sum(by.values()) == pytest.approx(2110)
    assert by[None] == 30 and by["c"] == 0 and by["a"] == 300  # at the cap
    assert by["b"] == pytest.approx(2 * by["é"])
    assert M.source_targets(sizes.iloc[:0])["target"].tolist() == []


def test_pieces_against_the_streams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    config = M.MixConfig(block=32, slots=128, part_docs=17)
    placed, pieces, targets = M.mix_plan(docs, config)
    rows, got = placed.toPandas(), pieces.toPandas()
    for _, s in rows.groupby("source"):
        s = s.sort_values("start")
        assert (s["start"].to_numpy() == np.concatenate([[0], np.cumsum(s["size"])[:-1]])).all()
    source = dict(zip(rows["doc_id"], rows["source"]))
    blocks = defaultdict(Counter)
    for r in got.itertuples():
        assert r.start // 32 <= r.block <= (r.start + r.size - 1) // 32
        assert r.start + r.first == max(r.start, r.block * 32) and r.words == min(r.start + r.size, r.block * 32 + 32) - r.start - r.first
        blocks[source[r.doc_id]][r.block, r.slot] += 1
    for s, size, target in zip(targets["source"], targets["size"], targets["target"]):
        n = -(-size // 32)
        times = Counter(b for b, _ in blocks[s])
        assert len(set(times.values())) <= 2 or max(times.values()) - min(times.values()) <= 1
        assert max(times.values()) <= 3 and max(b for b in times) < n


def test_taken_words(spark):
    rows = M.op8_mixing(spark, SF).toPandas()
    again = M.op8_mixing(spark, SF).toPandas()
    keys = ["doc_id"]
    assert rows.sort_values(keys).reset_index(drop=True).equals(again.sort_values(keys).reset_index(drop=True))
    assert (rows["taken"] <= 3 * rows["size"]).all()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().merge(rows, on="doc_id")
    assert docs["size"].tolist() == [len(t.split()) for t in docs["text"]]
    by = docs.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), own=("size", "sum"))
    assert (by["size"] == by["own"]).all() and by["target"].sum() == pytest.approx(by["size"].sum())
    assert ((by["taken"] - by["target"]).abs() <= 600).all()


def test_taken_words_word_by_word(spark):
    """Every word of a stream is taken as often as its block is; every pass takes each block once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    config = M.MixConfig(block=32, slots=128, part_docs=17, task_slots=100)
    placed, pieces, targets = M.mix_plan(docs, config)
    slots = M.block_takes(spark, targets, config)
    assert slots.rdd.getNumPartitions() >= 32
    got = slots.toPandas()
    times = Counter(zip(got["no"], got["block"]))
    for no, mine in got.groupby("no"):
        n = -(-int(targets["size"][no]) // config.block)
        assert sorted(mine["slot"]) == list(range(len(mine)))
        for _, turn in mine.groupby(mine["slot"] // n):
            assert turn["block"].is_unique and turn["block"].between(0, n - 1).all()
    per_shard = got.groupby("shard").size()
    assert (per_shard.iloc[:-1] == config.slots).all() and per_shard.iloc[-1] <= config.slots
    number = {s: i for i, s in enumerate(targets["source"])}
    want = Counter()
    for r in placed.toPandas().itertuples():
        want[r.doc_id] = sum(times[number[r.source], w // config.block] for w in range(r.start, r.start + r.size))
    taken = pieces.groupBy("doc_id").agg({"words": "sum"}).toPandas()
    assert dict(zip(taken["doc_id"], taken["sum(words)"])) == {d: n for d, n in want.items() if n}


def test_mixed_texts(spark):
    docs = edge_docs(spark)
    config = M.MixConfig(block=16, slots=64, part_docs=3)
    out = M.mix(docs, config)
    assert out.columns == docs.columns
    rows = out.toPandas()
    placed, pieces, _ = M.mix_plan(docs, config)
    assert sum(len(t.split()) for t in rows["text"]) == pieces.agg({"words": "sum"}).first()[0]
    assert (rows["n_chars"] == rows["text"].str.len()).all()
    assert all(t in LONG for t in rows.loc[rows["doc_id"] == 5, "text"])
    assert not rows["doc_id"].isin([3, 4, 6]).any()  # without words
    assert M.mix(no_docs(spark)).count() == 0
