import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cases import LONG, edge_docs, no_docs, rows
from plaudit.llm import token_alignment as X

A = Tokenizer.from_file(f"{X.FOLDER}/byte_bpe_50k.json")
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=f"{X.FOLDER}/piece_bpe_32k.model")
HARD = [
    "a  b\n\n c\t d 　e\xa0f  ", " lead", "trail ", "  ", "\n", "it's we'll I'VE '", "<|endoftext|> <s> </s> <unk> <0x0A>", "▁ block ▁x",
    "漢字かな 交じり文", "😀👍🏽 é ﬁ ½ ⅷ", "x" * 500, "a\x1cb c\x85 d  e", "\x00 nul", "１２３ 123456789", "words, and. more; (words) — “quoted”…", "İ ß ſ",
    "​ zero ﻿ bom", "tab\t\ttab \r\n line", "한국어 문장", "مرحبا بالعالم", "a" + " " * 50 + "b", "#### ****\n%%%",
]


def brute(text):
    """Groups by walking both lists of whole-text tokens: (a ids, b ids) per group, None without tokens."""
    if not text:
        return None
    data = (" " + text).encode()
    letters = X.byte_of_char()
    a_ids, b_ids = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a_bytes = [bytes(letters[c] for c in A.id_to_token(i)) for i in a_ids if A.id_to_token(i) != "<|endoftext|>"]
    b_bytes = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
        return None
    out, i, j, x, y = [], 0, 0, 0, 0
    for end in range(1, len(data) + 1):
        left, right = [], []
        k, m, p, q = i, j, x, y
        while k < len(a_ids) and p < end:
            p += len(a_bytes[k])
            k += 1
        while m < len(b_ids) and q < end:
            q += len(b_bytes[m])
            m += 1
        if p == q == end:
            left, right = a_ids[i:k], b_ids[j:m]
            out.append((left, right))
            i, j, x, y = k, m, p, q
    return out


def want(texts):
    groups = [brute(t) for t in texts]
    links = [[a * X.SHIFT + b for left, right in g or [] for a in left for b in right] for g in groups]
    count = Counter(p for ps in links for p in set(ps))
    most = defaultdict(int)
    for p, n in count.items():
        most[p // X.SHIFT] = max(most[p // X.SHIFT], n)
    out = []
    for g, ps in zip(groups, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out.append((
            sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(ps),
            sum(count[p] == most[p // X.SHIFT] for p in ps), sum(count[p] for p in ps), hashlib.sha256(shown.encode()).hexdigest() if g else "",
        ))
    return out


@pytest.fixture(scope="module")
def both():
    return X.tokenizers(X.FOLDER, "byte_bpe_50k.json", "piece_bpe_32k.model")


def test_texts_against_whole_walk(both, monkeypatch):
    rnd = random.Random(3)
    signs = [*" \n\t\xa0\u3000\x1c\x85ab'.9é漢😀▁", "the", " and", "s", "\r\n", "ll"]
    texts = HARD + ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    for large in (X.LARGE, 3):
        monkeypatch.setattr(X, "LARGE", large)
        for text in texts:
            g = brute(text)
            n_a, n_b, groups, links, digest, pairs, times = both.document(text)
            if g is None:
                assert (n_a, digest, len(pairs)) == (0, "", 0), repr(text)
                continue
            shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            assert digest == hashlib.sha256(shown.encode()).hexdigest(), repr(text)
            assert dict(zip(pairs.tolist(), times.tolist())) == Counter(a * X.SHIFT + b for left, right in g for a in left for b in right)
            assert (groups, links) == (len(g), times.sum())


def test_alignment_of_given_lists():
    a, b = np.array([1, 2, 2, 3]), np.array([7, 8, 7])
    cuts = X.common_ends(np.array([1, 3, 4, 6]), np.array([2, 4, 6]))
    assert (cuts.a.tolist(), cuts.b.tolist()) == ([3, 4], [2, 3])
    pairs, times = X.linked_pairs(a, b, cuts)
    assert dict(zip(pairs.tolist(), times.tolist())) == {X.SHIFT + 7: 1, X.SHIFT + 8: 1, 2 * X.SHIFT + 7: 2, 2 * X.SHIFT + 8: 2, 3 * X.SHIFT + 7: 1}


@pytest.mark.parametrize("frequent", [0, 40, 1 << 18])
def test_documents(spark, monkeypatch, frequent):
    monkeypatch.setattr(X, "FREQUENT", frequent)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*HARD, *HARD[:5], None, "", LONG[:20_000]])], "doc_id long, text string")
    got = X.alignments(docs.repartition(5)).orderBy("doc_id").collect()
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert [tuple(r)[1:] for r in got] == want(texts)


def test_edge_rows(spark):
    docs = edge_docs(spark)
    got = X.alignments(docs).collect()
    texts = [r[1] for r in rows()]
    expected = [(r[0], *w) for r, w in zip(rows(), want([t if t != LONG else None for t in texts])) if r[1] != LONG]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    short = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) for r in got if r["doc_id"] != 5]
    assert sorted(short, key=key) == sorted([e[:5] for e in expected], key=key)
    long = next(r for r in got if r["doc_id"] == 5)
    assert long["n_a"] > 100_000 and long["n_links"] >= long["n_groups"] >= len(LONG.split())
    assert X.alignments(no_docs(spark)).count() == 0
