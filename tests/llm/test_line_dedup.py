import random

import numpy as np
import pytest
from cases import LONG, PLAIN, docs_of, edge_docs, no_docs
from pyspark.sql import functions as F

from plaudit.llm import line_dedup as D

CONFIG = D.DedupConfig()
R = random.Random(9)
WORDS = [f"{a}{b}" for a in "abcdefgh" for b in "lmnopqrst"]


def prose(n, r=R):
    out = []
    while len(out) < n:
        s = r.choices(WORDS, k=r.randint(3, 12))
        out += [*s[:-1], s[-1] + "."]
    return " ".join(out[:n])


def test_folds_do_not_depend_on_what_stands_around():
    passage = prose(60)
    alone, _ = D.fold_all([passage.encode()])
    inside, _ = D.fold_all([f"some words before {passage} and words behind\nline".encode()])
    run = alone[1:-1].tolist()
    assert any(inside[i : i + len(run)].tolist() == run for i in range(len(inside)))
    lines, begin = D.fold_all([("same " * 1000).encode(), b" \n ", b"", b"end"])
    assert begin.tolist() == [0, 1000, 1000, 1000, 1001] and len(set(lines.tolist())) == 2


def test_shared_runs_have_a_common_fingerprint():
    rng = np.random.default_rng(1)
    for _ in range(50):
        run = rng.integers(0, 1 << 32, CONFIG.window + CONFIG.gram - 1).astype(np.uint32)
        a = np.concatenate([rng.integers(0, 1 << 32, rng.integers(0, 30)).astype(np.uint32), run, rng.integers(0, 1 << 32, 9).astype(np.uint32)])
        b = np.concatenate([rng.integers(0, 1 << 32, rng.integers(0, 30)).astype(np.uint32), run])
        assert set(D.winnowed(a, CONFIG)[0]) & set(D.winnowed(b, CONFIG)[0])


def windows(text, k):
    w = text.split()
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages_go_and_the_rest_stays(spark, seed):
    r = random.Random(seed)
    passages = [prose(n, r) for n in (52, 60, 90, 200)]
    texts = []
    for i in range(60):
        own = prose(r.randint(20, 150), r).split(" ")
        for p in r.sample(passages, r.choice([0, 0, 1, 2])):
            at = r.randrange(len(own) + 1)
            own[at:at] = [r.choice(["", "\n", "\n\n"]) + p]
        texts.append(" ".join(own))
    texts[40] = texts[3]
    rows = D.dedup_lines(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    seen = {}
    for i, text in enumerate(rows["text"]):
        for w in windows(text, 51):
            assert seen.setdefault(w, i) == i, "a long passage is left twice"
    earlier = set()
    for i, (old, new, removed) in enumerate(zip(texts, rows["text"], rows["removed_words"])):
        assert len(old.split()) - len(new.split()) == removed
        here = set(windows(old, 20))
        if not removed:
            assert new == old
            assert not any(w in earlier for w in windows(old, 51))
        lost = [w for w in windows(old, 20) if w not in set(windows(new, 20))]
        kept_words = len(new.split())
        if removed and kept_words == 0:
            assert all(w in earlier for w in lost)
        earlier |= here
    assert rows["removed_words"].sum() > 0


def test_short_repeats_stay(spark):
    shared = prose(30)
    texts = [prose(60) + "\n" + shared + "\n" + prose(60) for _ in range(6)]
    rows = D.dedup_lines(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    assert rows["text"].tolist() == texts


def test_repeats_inside_a_document(spark):
    p, q = prose(70), prose(70)
    text = f"{p}\n{q}\n{p}"
    row = D.dedup_lines(docs_of(spark, [text])).first()
    assert row.removed_words >= 60 and row.text.startswith(f"{p}\n{q}")


def test_edges(spark):
    docs = edge_docs(spark)
    out = D.dedup_lines(docs)
    rows = out.toPandas()
    assert len(rows) == docs.count() and set(docs.columns) == set(rows.columns)
    assert rows["text"].isna().sum() == 2 and (rows.loc[rows["doc_id"] == 5, "text"] == LONG).all()
    assert (rows.loc[rows["doc_id"] == 1, "text"] == PLAIN).all()
    assert D.dedup_lines(no_docs(spark)).count() == 0
    twice = D.dedup_lines(docs.unionByName(docs)).toPandas()
    assert (twice.loc[twice["doc_id"] == 5, "text"] == LONG).all()  # rows alike are one document


def test_winnowing_text_by_text_and_side_by_side():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 9, n).astype(np.uint32) for n in (0, 1, 2, 3, 5, 9, 10, 40, 0, 200)]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    marks, owner, at = D.winnow_all(np.concatenate(texts), begin, CONFIG)
    for i, t in enumerate(texts):
        one = D.winnowed(t, CONFIG)
        assert one[0].tolist() == marks[owner == i].tolist() and one[1].tolist() == at[owner == i].tolist()
        assert (len(one[0]) > 0) == (len(t) > 0)
        if len(t) >= CONFIG.gram + CONFIG.window - 1:  # every window has a mark
            gaps = np.diff(np.concatenate([[-1], one[1], [len(t) - CONFIG.gram + 1]]))
            assert gaps.max() <= CONFIG.window


@pytest.mark.parametrize("marks", [True, False])
def test_passages_of_51_words_and_more_in_the_middle_of_a_sentence(spark, marks):
    r = random.Random(21)
    own = lambda n: r.choices([f"{a}{b}{c}" for a in "abcdefgh" for b in "lmnopqrst" for c in "uvwxyz"], k=n)
    texts, planted = [], []
    for n in [*range(51, 61)] * 4:
        passage = (prose(n, r) if marks else " ".join(own(n))).split(" ")
        planted.append(" ".join(passage))
        texts += [" ".join([*own(r.randint(30, 90)), *passage, *own(r.randint(30, 90))]) for _ in range(2)]
    texts.append("\n".join(["plain words"] * 15))
    rows = D.dedup_lines(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    for k, passage in enumerate(planted):
        first, later = rows["text"].iloc[2 * k], rows["text"].iloc[2 * k + 1]
        assert first == texts[2 * k] and passage not in later
        assert rows["removed_words"].iloc[2 * k + 1] >= len(passage.split()) and not set(windows(passage, 12)) & set(windows(later, 12))


def test_a_passage_of_a_middle_document_goes_whose_sentence_stood_before(spark):
    r = random.Random(23)
    own = lambda n: r.choices([f"{a}{b}{c}" for a in "abcdefgh" for b in "lmnopqrst" for c in "uvwxyz"], k=n)
    texts, n = [], 12
    for _ in range(n):
        passage = own(60)
        # Earlier documents hold each piece of 36 words of it, so no short fingerprint is new in the second holder.
        pieces = [[*own(20), *passage[at : at + 36], *own(20)] for at in range(0, 25, 3)]
        texts += [" ".join(x) for x in [*pieces, [*own(50), *passage, *own(50)], [*own(50), *passage, *own(50)]]]
    rows = D.dedup_lines(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    size = len(texts) // n
    later = rows["removed_words"].iloc[size - 1 :: size]
    assert (later >= 60).all() and rows["removed_words"].sum() == later.sum()


def test_texts_without_id_whose_32_bit_hashes_collide_are_two_documents(spark):
    r = random.Random(25)
    passage, other = prose(60, r), prose(60, r)
    a = spark.range(400_000).select(F.concat(F.lit(passage + " a"), "id").alias("a")).withColumn("h", F.hash("a"))
    b = spark.range(400_000).select(F.concat(F.lit(other + " b"), "id").alias("b")).withColumn("h", F.hash("b"))
    met = a.join(b, "h").select("a", "b").first()
    docs = spark.createDataFrame([(1, passage), (None, met.a), (None, met.b)], "doc_id long, text string")
    rows = {r.text: r.removed_words for r in D.dedup_lines(docs).collect()}
    assert rows == {passage: 0, met.a.split(" ")[-1]: 60, met.b: 0}


@pytest.mark.parametrize("period", [1, 7, 25, 39, 40, 55])
def test_periodic_text_keeps_a_run_of_its_own(spark, period):
    words = [f"w{period}x{i}" for i in range(period)]
    texts = [" ".join((words * 300)[:300]), " ".join((words * 300)[:60]), prose(80)]
    rows = D.dedup_lines(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    first, second = rows["text"].iloc[0], rows["text"].iloc[1]
    everywhere = {w for t in rows["text"] for w in windows(t, 40)}
    assert first.startswith(" ".join((words * 40)[:40])) and len(first.split()) < 120 and rows["text"].iloc[2] == texts[2]
    n = max(1, 41 - period)  # a run of 40 words holds all runs of that many
    assert set(windows(first, n)) == set(windows(texts[0], n))
    assert everywhere & set(windows(texts[0], 40)) and not set(windows(second, 51))
