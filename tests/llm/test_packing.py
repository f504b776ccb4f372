import itertools
import random

import numpy as np
import pytest
from cases import LONG, edge_docs, no_docs

from plaudit.llm import packing as P


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    r = random.Random(seed)
    lengths = sorted(r.sample(range(1, 60), 9))
    counts = [r.randint(1, 20) for _ in lengths]
    for k in (1, 2, 4):
        got = P.best_boundaries(np.array(lengths), np.array(counts), k)
        tries = (set(c) | {lengths[-1]} for n in range(k) for c in itertools.combinations(lengths, n))
        assert len(got) <= k
        assert padding(lengths, counts, got) == min(padding(lengths, counts, b) for b in tries)


def test_one_bucket_per_length_has_no_padding():
    assert P.best_boundaries(np.array([2, 5]), np.array([1, 1]), 9) == [2, 5]
    assert P.best_boundaries(np.zeros(0), np.zeros(0), 4) == []


def test_plan_holds_every_token_once(spark):
    config = P.PackConfig(max_length=64, buckets=4, budget=256, part_pieces=50)
    docs = edge_docs(spark)
    plan = P.pack(docs, config=config).toPandas()
    sizes = [len((t or "").split()) for t in docs.toPandas()["text"]]
    assert plan["n_tokens"].sum() == sum(sizes)
    assert (plan["n_tokens"] + plan["padding"] == plan["bucket_length"]).all() and (plan["padding"] >= 0).all()
    assert not plan.duplicated(["bucket", "batch", "slot"]).any()
    long = plan[plan["doc_id"] == 5].sort_values("piece")
    assert (long["first"] == long["piece"] * 64).all() and long["n_tokens"].sum() == len(LONG.split())
    for _, b in plan.groupby("bucket"):
        full = b["bucket_length"].iloc[0]
        sizes = b.groupby("batch").size().sort_index()
        assert (sizes.iloc[:-1] == 256 // full).all() and sizes.iloc[-1] <= 256 // full
        assert list(sizes.index) == list(range(len(sizes)))


def test_padded_batches(spark):
    config = P.PackConfig(max_length=8, buckets=2, budget=16)
    docs = edge_docs(spark).filter("doc_id in (1, 7, 9)")
    rows = P.padded_batches(docs, P.pack(docs, config=config), config).toPandas()
    got = {}
    for r in sorted(rows.itertuples(), key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(w for w in r.words if w)
    for d, t in docs.select("doc_id", "text").collect():
        assert got[d] == t.split()


def test_empty_and_bad_arguments(spark):
    assert P.pack(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        P.PackConfig(max_length=10, budget=5)


def test_reruns_agree(spark):
    config = P.PackConfig(max_length=32, buckets=3, budget=96)
    a, b = (P.pack(edge_docs(spark), config=config).toPandas() for _ in range(2))
    keys = ["bucket", "batch", "slot"]
    assert a.sort_values(keys).reset_index(drop=True).equals(b.sort_values(keys).reset_index(drop=True))
