import random
from itertools import combinations

import numpy as np
import pytest
from cases import docs_of, edge_docs, no_docs
from pyspark.sql import functions as F

from plaudit.llm import jaccard_join as J
from plaudit.llm.common import stored


def word_sets(texts, k=5):
    out = []
    for t in texts:
        w = t.split()
        n = min(k, len(w))
        out.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    return out


def brute(texts, threshold=0.8):
    """Links per text and the first member of its class."""
    sets, n = word_sets(texts), len(texts)
    links, first = [0] * n, list(range(n))

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, j in combinations(range(n), 2):
        a, b = sets[i], sets[j]
        if len(a & b) >= threshold * len(a | b):
            links[i] += 1
            links[j] += 1
            x, y = sorted((root(i), root(j)))
            first[y] = x
    return links, [root(i) for i in range(n)]


def corpus(seed, bases=12, near=12, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(vocabulary, k=12))
    texts = []
    for b in range(bases):
        base = r.choices(vocabulary, k=words)
        for _ in range(r.choice([1, 1, 2, 3, near])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy) + (" " + passage if b % 2 else ""))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("config", [J.JoinConfig(), J.JoinConfig(limit=4, chunk=6, pivots=3, tile=5, recall=0.9999)])
def test_against_all_pairs(spark, config):
    texts = corpus(1) + ["", "", "a b", "a b", "a b c", *["dense " + " ".join(f"d{i}" for i in range(80)) + f" {k}" for k in range(40)]]
    rows = J.join_classes(docs_of(spark, texts), config).toPandas().sort_values("doc_id")
    links, classes = brute(texts)
    assert rows["doc_id"].tolist() == list(range(len(texts)))
    assert rows["n_links"].tolist() == links
    assert rows["class_id"].tolist() == classes


@pytest.mark.parametrize("shared", [49, 57])
def test_pairs_in_a_large_group_with_a_template(spark, shared):
    """3,000 texts share a template, so that a bucket of them does not split and is dealt into
    chunks; among them are pairs at 0.80 to 0.82 and at 0.85."""
    r = random.Random(shared)
    words = 120
    template = r.choices([f"t{i}" for i in range(5000)], k=round(words * 2 * shared / (100 + shared)))
    texts, planted = [], []
    for i in range(2600):
        own = [f"o{i}x{k}" for k in range(words - len(template))]
        texts.append(template + own)
        if i < 400:  # the last words of the copy differ: s of 120 - 4 grams each
            s = 12 if i % 2 else 9
            texts.append((template + own)[:-s] + [f"p{i}x{k}" for k in range(s)])
            planted.append((len(texts) - 2, len(texts) - 1))
    texts = [" ".join(t) for t in texts]
    sets = word_sets(texts)
    near = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in planted]
    assert all(0.80 <= j <= 0.86 for j in near) and min(near) < 0.82
    rows = J.join_classes(docs_of(spark, texts)).toPandas().set_index("doc_id").sort_index()
    linked = {a for a, _ in planted} | {b for _, b in planted}
    assert (rows["n_links"] == [1 if i in linked else 0 for i in range(len(texts))]).all()
    assert all(rows["class_id"][a] == rows["class_id"][b] == a for a, b in planted)


def test_common_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(30)]
    got = J.common_counts(sets)
    for i, j in combinations(range(30), 2):
        assert got[i, j] == got[j, i] == len(np.intersect1d(sets[i], sets[j]))
    assert [got[i, i] for i in range(30)] == [len(s) for s in sets]


def test_recall_of_a_run():
    """Pairs at the threshold share a sampled token on every level as often as the bound says."""
    config, rng, hits = J.JoinConfig(), np.random.default_rng(3), 0
    kept = (1 - np.exp(-config.width * config.threshold)) ** config.levels
    for _ in range(40):
        t = np.unique(rng.integers(0, 1 << 63, 180).astype(np.uint64))
        a, b = t[: 160], np.concatenate([t[18:160], t[160:]])
        sa, sb = J.sampled(a, config), J.sampled(b, config)
        for run in range(config.runs):
            mine = [set(x[(x & np.uint64(255)) == run].tolist()) & set(y[(y & np.uint64(255)) == run].tolist()) for x, y in zip(sa, sb)]
            hits += all(mine)
    assert hits / (40 * config.runs) > kept - 0.05


def test_connected_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(7, i) for i in range(200, 230)]
    first = {}
    for a, b in pairs:
        first.setdefault(a, a), first.setdefault(b, b)
    for _ in range(200):
        for a, b in pairs:
            first[a] = first[b] = min(first[a], first[b])
    got = {x.node: x.first for x in J.connected(stored(spark.createDataFrame(pairs, "a long, b long"))).collect()}
    assert all(got.get(n, n) == f for n, f in first.items())


def test_edges(spark):
    docs = edge_docs(spark)
    rows = J.join_classes(docs).toPandas()
    assert len(rows) == docs.count()
    plain = rows[(rows["class_id"] == 1) & (rows["n_copies"] == 4)]
    assert len(plain) == 4 and (plain["class_id"] == 1).all() and (plain["n_links"] == 3).all()  # one of them has no id
    blank = rows[(rows["class_id"] == 3) & (rows["n_links"] == 3)]
    assert len(blank) == 4
    kept = J.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == rows.drop_duplicates(["class_id", "class_th"]).shape[0]
    assert J.join_classes(no_docs(spark)).count() == 0 and J.keep_first(no_docs(spark)).count() == 0


def test_texts_without_id_whose_32_bit_hashes_collide_are_two_documents(spark):
    texts = spark.range(400_000).select(F.concat(F.lit("some words of text number "), "id", F.lit(" and "), F.col("id") * 7 + 1, F.lit(" at the end")).alias("text"))
    met = texts.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("texts")).filter("size(texts) > 1").first().texts
    kept = J.keep_first(spark.createDataFrame([(None, t) for t in met], "doc_id long, text string"))
    assert sorted(r.text for r in kept.collect()) == sorted(met)


def test_pairs_in_different_chunks_meet(spark, monkeypatch):
    """sets of a large bucket met in their own chunk or through pivots only."""
    one_bucket = lambda sets, config: sets.select(F.lit(1).cast("long").alias("path"), "doc", F.lit(60).cast("long").alias("n"))
    monkeypatch.setattr(J, "buckets", one_bucket)
    config = J.JoinConfig(chunk=2, pivots=1)
    texts = [" ".join(f"{k}{c}" for c in "abcdefghijkl") + (" z" if odd else "") for k in range(30) for odd in (0, 1)]
    signed = J.signatures(docs_of(spark, texts), config).select("doc", "sketch", "chosen")
    edges = {frozenset((r.a.id, r.b.id)) for r in J.candidates(signed, config).collect()}
    assert edges == {frozenset((2 * k, 2 * k + 1)) for k in range(30)}
