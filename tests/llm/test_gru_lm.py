import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import docs_of, edge_docs, no_docs

from plaudit.llm import gru_lm as G

SF = "/root/testdata/sf0.01"
SMALL = G.LmConfig(vocabulary=10, known=20, embedding=3, hidden=4, window=5, span=12, lanes=4, block=3)


def small_model(seed=0):
    counts = {b"w%d" % i: 30 - i for i in range(20)} | {G.END: 28}
    ranked = sorted(counts, key=lambda w: -counts[w])[:10]
    total = sum(counts.values())
    ids = {w: i for i, w in enumerate(ranked)}
    mass = np.full(G.TAILS, 0.1)
    for w in set(counts) - set(ids):
        mass[G.tail_of(w)] += counts[w] + 0.1
    vocabulary = G.Vocabulary(ids, counts, total, len(counts), mass / (total + 0.1 * (len(counts) + 1)), 0.1)
    net = G.Gru(vocabulary, SMALL)
    rng = np.random.default_rng(seed)
    for k in net.w:
        net.w[k] = np.where(net.w[k] > -100, net.w[k] + rng.normal(0, 0.3, net.w[k].shape), net.w[k])
    return vocabulary, net


def test_probabilities_sum_to_one():
    _, net = small_model()
    hidden = np.random.default_rng(1).normal(size=(1, 4)).astype(np.float32)
    ids = np.arange(net.n_words + G.TAILS)
    out, _, _ = net.log_probs(np.repeat(hidden, len(ids), 0), ids)
    assert np.exp(out).sum() == pytest.approx(1, abs=1e-5)


def test_gradients_numerically():
    _, net = small_model()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(2)
    ids, target = rng.integers(0, net.n_words + G.TAILS, (5, 3)), rng.integers(0, net.n_words + G.TAILS, (5, 3))
    state = np.zeros((3, 4))

    def loss():
        hidden, _, _ = net.steps(ids, state)
        return -net.log_probs(hidden.reshape(-1, 4).astype(np.float64), target.reshape(-1))[0].mean()

    hidden, kept, x = net.steps(ids, state, keep=True)
    _, g, dh = net.log_probs(hidden.reshape(-1, 4).astype(np.float64), target.reshape(-1), gradient=True)
    g |= net.backward(ids, kept, x, dh.reshape(hidden.shape))
    for k, v in net.w.items():
        flat = v.reshape(-1)
        for i in rng.integers(0, flat.size, 6):
            if flat[i] < -100:
                continue
            old, eps = flat[i], 1e-3
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[k].reshape(-1)[i], abs=2e-3), k


def test_state_is_carried_through_whole_documents():
    _, net = small_model()
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, net.n_words + G.TAILS, n).astype(np.int32) for n in (1, 23, 7, 5, 40, 6, 10)]
    got = G.log_likelihoods(net, docs, 0)
    for d, value in zip(docs, got):
        state, total, before = np.zeros((1, 4), np.float32), 0.0, 0
        for t in d:
            hidden, _, _ = net.steps(np.array([[before]]), state)
            state = hidden[-1]
            total += net.log_probs(state, np.array([t]))[0][0]
            before = t
        assert value == pytest.approx(total / math.log(10), abs=1e-3)


def test_untrained_network_gives_the_base_score():
    vocabulary, _ = small_model()
    net = G.Gru(vocabulary, SMALL)
    words = [b"w1", b"w17", b"w3", G.END]
    got = G.log_likelihoods(net, [G._ids(words, vocabulary)], vocabulary.ids[G.END])[0]
    inside = sum(math.log10(vocabulary.base(vocabulary.counts[w]) / vocabulary.mass[G.tail_of(w)]) for w in words if w not in vocabulary.ids)
    assert got + inside == pytest.approx(sum(math.log10(vocabulary.base(vocabulary.counts[w])) for w in words), abs=0.02)  # each tail has room for an unseen word


def test_against_brute_force_counts(spark):
    rows = G.op4_gru_lm(spark, SF).toPandas().set_index("doc_id").sort_index()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").sort_index()
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in docs.index]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*t.translate(lower).encode().split(), b""] for t in docs["text"]]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    assert (rows["held_out"] == held).all() and (rows["train_tokens"] == n).all()
    assert rows["n_tokens"].tolist() == [len(t) for t in tokens]
    assert rows["n_known"].tolist() == [sum(w in c for w in t) for t in tokens]
    base = [sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t) for t in tokens]
    assert np.allclose(rows["base_score"], base)
    apart = rows[rows["held_out"]]
    assert apart["score"].sum() > 0.96 * apart["base_score"].sum() and (apart["score"] > apart["base_score"]).mean() > 0.9


def test_edges(spark):
    docs = edge_docs(spark).select("doc_id", "text", "th", "id")
    rows = G.score_corpus(docs, SMALL).toPandas()
    assert len(rows) == docs.count() and rows["score"].notna().all() and (rows["score"] < 0).all()
    alone = rows[rows["n_tokens"] == 1]
    assert len(alone) == 4 and alone["score"].round(6).nunique() == 1
    assert rows["doc_id"].isna().sum() == 2 and not rows[rows["doc_id"].isna()]["held_out"].any()
    twice = rows[(rows["doc_id"] == 2) & (rows["n_tokens"] == rows[rows["doc_id"] == 1]["n_tokens"].iloc[0])]
    assert len(twice) == 2 and twice["score"].nunique() == 1 and twice["base_score"].nunique() == 1
    assert G.score_corpus(no_docs(spark), SMALL).count() == 0
    unseen = G.score_corpus(docs_of(spark, ["a b"]).selectExpr("9L AS doc_id", "text").filter("crc32('9') % 10 = 0"), SMALL)
    assert unseen.count() in (0, 1)


def test_training_reads_every_token_with_carried_state(monkeypatch):
    _, net = small_model()
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, net.n_words + G.TAILS, n).astype(np.int32) for n in (1, 23, 7, 5, 40, 6, 10, 300, 2)]
    want = G.log_likelihoods(net, docs, 0).sum()
    trainer, got, plain = G.Trainer(net, SMALL, 0), [], net.log_probs

    def spied(hidden, target, gradient=False):
        out = plain(hidden, target, gradient)
        got.append(out[0])
        return out

    monkeypatch.setattr(net, "log_probs", spied)
    monkeypatch.setattr(trainer, "_update", lambda g: None)
    for d in docs:
        trainer.read(d)
    trainer.finish()
    assert trainer.tokens == sum(map(len, docs)) == len(np.concatenate(got))
    assert np.concatenate(got).sum() / math.log(10) == pytest.approx(want, rel=1e-4)


def test_every_part_of_a_long_document_is_learned_from(spark):
    words = [f"w{i * i % 37}" for i in range(3000)]
    vocabulary = G.vocabulary_of(G.word_counts(docs_of(spark, [" ".join(words)])), SMALL)
    plain = G.train(docs_of(spark, [" ".join(words)]), vocabulary, SMALL)
    for at in (300, 1400, 2600):
        moved = [*words[:at], *sorted(words[at : at + 40]), *words[at + 40 :]]
        other = G.train(docs_of(spark, [" ".join(moved)]), vocabulary, SMALL)
        assert any((plain[k] != other[k]).any() for k in plain), at


def test_windows_use_the_same_memory_again():
    config, ids = G.LmConfig(), {b"w%d" % i: i for i in range(4095)} | {G.END: 4095}
    vocabulary = G.Vocabulary(ids, dict.fromkeys(ids, 5), 5 * 4096, 4096, np.full(G.TAILS, 0.01), 0.1)
    trainer, rng = G.Trainer(G.Gru(vocabulary, config), config, ids[G.END]), np.random.default_rng(1)
    for _ in range(config.lanes - 1):
        trainer.read(rng.integers(0, len(ids) + G.TAILS, 400).astype(np.int32))
    trainer._window()
    tracemalloc.start()
    try:
        trainer._window()
        assert tracemalloc.get_traced_memory()[1] < 3_000_000  # it was 6.3 MB
    finally:
        tracemalloc.stop()


def test_texts_are_cut_in_batches_of_columns():
    texts = ["Ab  c\x85d\r\n", "", None, " \x0b ", "ÄA é\u2003É 7. x", "no" * 9]
    tokens, bounds = G.tokens_of(pa.array(texts, pa.string()))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [[*(t or "").translate(lower).encode().split(), G.END] for t in texts]
    assert [tokens.to_pylist()[a:b] for a, b in zip(bounds, bounds[1:])] == want
    assert G.tails_of(tokens).tolist() == [G.tail_of(w) for ws in want for w in ws]
    assert G.tails_of(tokens[2:]).tolist() == [G.tail_of(w) for ws in want for w in ws][2:]
    assert len(G.tails_of(tokens[:0])) == 0
    vocabulary, _ = small_model()
    assert G.ids_of(pa.array([b"w0", b"zz", G.END, b"w15"], pa.binary()), vocabulary).tolist() == [0, 10 + G.tail_of(b"zz"), vocabulary.ids[G.END], 10 + G.tail_of(b"w15")]


def test_scoring_holds_what_a_cache_holds():
    config, ids = G.LmConfig(), {b"w%d" % i: i for i in range(4095)} | {G.END: 4095}
    vocabulary = G.Vocabulary(ids, dict.fromkeys(ids, 5), 5 * 4096, 4096, np.full(G.TAILS, 0.01), 0.1)
    net, rng = G.Gru(vocabulary, config), np.random.default_rng(1)
    docs = [rng.integers(0, len(ids) + G.TAILS, 40).astype(np.int32) for _ in range(1500)]
    tracemalloc.start()
    try:
        G.log_likelihoods(net, docs, ids[G.END])
        assert tracemalloc.get_traced_memory()[1] < 12_000_000  # it was 74 MB
    finally:
        tracemalloc.stop()
