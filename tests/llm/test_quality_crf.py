import itertools
import tracemalloc

import numpy as np
import pytest
from cases import edge_docs, no_docs, no_labels

from plaudit.llm import quality_crf as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [1, 2, 5])
def test_marginals_by_enumeration(n):
    rng = np.random.default_rng(n)
    score, move, first = rng.normal(size=n), rng.normal(size=(2, 2)), rng.normal()
    good, pairs, log_z = Q._forward_backward(score, move, first, np.array([0, n]))
    total, want, want_pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=n):
        s = first * y[0] + sum(score[i] * y[i] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1))
        total += np.exp(s)
        want += np.exp(s) * np.array(y)
        for i in range(n - 1):
            want_pairs[y[i], y[i + 1]] += np.exp(s)
    assert np.allclose(good, want / total) and np.allclose(pairs, want_pairs / total)
    assert np.allclose(log_z[0], np.log(total))


def test_texts_side_by_side_do_not_mix():
    rng = np.random.default_rng(3)
    score, move = rng.normal(size=9), rng.normal(size=(2, 2))
    begin = np.array([0, 4, 5, 9])
    good, _, log_z = Q._forward_backward(score, move, 0.3, begin)
    for k, (a, b) in enumerate(zip(begin, begin[1:])):
        one, _, z = Q._forward_backward(score[a:b], move, 0.3, np.array([0, b - a]))
        assert np.allclose(good[a:b], one) and np.allclose(z[0], log_z[k])


def test_features_of_lines():
    x, length, begin = Q.line_features(["AB# AB#\nab", "", "ab"])
    at = {n: i for i, n in enumerate(Q.FEATURES)}
    assert begin.tolist() == [0, 2, 3, 4] and length.tolist() == [7, 2, 0, 2]
    assert x[0, at["upper"]] == pytest.approx(4 / 6) and x[0, at["repeats"]] == 0.5
    assert x[1, at["before_upper"]] == pytest.approx(4 / 6) and x[0, at["before_upper"]] == 0
    assert x[3, at["before_upper"]] == 0  # another text's line is no neighbour


def test_bad_lines_far_inside_are_learned_from(spark):
    """Long documents are whole in the fit: the bad ones differ from the good ones in a passage at
    the end alone, beyond many lines that look the same."""
    plain, bad = "some plain words of a common line\n", "#### $$$$ !!!! BUY NOW #### $$$$\n"
    texts = [plain * 300 + (bad if i % 2 else plain) * 60 for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, texts[1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    rows = Q.score(docs, Q.train(docs, labels)).toPandas()
    assert (rows["predicted"] == 1 - rows["doc_id"] % 2).all()
    assert (rows.loc[rows["predicted"] == 0, "bad_lines"] >= 60).all() and (rows.loc[rows["predicted"] == 1, "bad_lines"] <= 1).all()
    # The bound on lines leaves whole documents: 360 lines and an empty last one each.
    few = Q.train(docs, labels, Q.CrfConfig(lines=361 * 4))
    assert np.isfinite(few.emission).all()
    none = Q.train(docs, labels, Q.CrfConfig(lines=100))
    assert (none.emission == 0).all()


def test_chains_cut_in_the_fit_keep_their_first_line():
    rng = np.random.default_rng(5)
    score, move = rng.normal(size=7), rng.normal(size=(2, 2))
    good, _, _ = Q._forward_backward(score, move, np.array([0.7, 0.0]), np.array([0, 5, 7]))
    assert np.allclose(good[:5], Q._forward_backward(score[:5], move, 0.7, np.array([0, 5]))[0])
    assert np.allclose(good[5:], Q._forward_backward(score[5:], move, 0.0, np.array([0, 2]))[0])


def test_held_out_accuracy(spark):
    rows = Q.op2_quality_crf(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    met = labels.merge(rows[rows["held_out"]], on="doc_id")
    assert len(rows) == 1000 and rows["score"].between(0, 1).all()
    assert (met["predicted"] == met["quality"]).mean() >= 0.96
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all()


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1), (9, 0), (9, 1), (None, 1), (7, None), (2, 1), (3, 0)], "doc_id long, quality int")
    rows = Q.score(docs, Q.train(docs, labels)).toPandas()
    assert len(rows) == docs.count() and rows["score"].between(0, 1).all()
    empty = rows[rows["text"].isna() | (rows["text"] == "")]["score"]
    assert empty.nunique() == 1
    assert set(docs.columns) <= set(rows.columns)
    assert Q.score(no_docs(spark), Q.train(no_docs(spark), no_labels(spark))).count() == 0
    flat = Q.score(docs, Q.train(docs, no_labels(spark))).toPandas()
    assert (flat["score"] == 0.5).all()


def test_memory_of_features_is_that_of_a_block_of_lines(monkeypatch):
    texts = [f"{i} {'Some words words, and more of them! ' * 20}\n" * 100 for i in range(100)]
    Q.line_features(texts[:1])
    tracemalloc.start()
    try:
        whole = Q.line_features(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 6 * sum(a.nbytes for a in whole) + 60 * Q.BLOCK < 5 * sum(map(len, texts))  # it was 30 bytes a character
    mixed = ["", "\n", "a a\na", "a a b\n\n b", "x" * 30 + "\nx y", "é é\t\U0001f600", " "]
    want = Q.line_features(mixed)
    for size in (1, 2, 5, 11):
        monkeypatch.setattr(Q, "BLOCK", size)
        assert all((a == b).all() for a, b in zip(want, Q.line_features(mixed))), size
