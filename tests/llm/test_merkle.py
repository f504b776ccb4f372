import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cases import edge_docs, no_docs, rows
from plaudit.llm import merkle as X

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return h("".join(fields))


def levels(nodes):
    """All levels of a tree, by the plain rule: runs of two, the last may be one."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def walk(tree, pos, start):
    """Siblings from the leaf up, and the root that ``start`` gives."""
    siblings = []
    for level in tree[:-1]:
        run = level[pos - pos % 2 : pos - pos % 2 + 2]
        other = [x for i, x in enumerate(run) if i != pos % 2]
        siblings += other
        start = h(*([start] + other if pos % 2 == 0 else other + [start]))
        pos //= 2
    return siblings, start


def brute(docs):
    """doc_id, leaf, subroot, root, proof, folded root and verified of every document."""
    changed = [r if r[0] is None or r[4] is None or zlib.crc32(str(r[0]).encode()) % 7 else (*r[:4], r[4] + 1) for r in docs]
    groups = {}
    for r, c in zip(docs, changed):
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r[0], leaf(*c)))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([x[2] for x in sorted(groups[k])]) for k in keys}
    crown = levels([trees[k][-1][0] for k in keys])
    out = []
    for at, k in enumerate(keys):
        for pos, (_, _, own, doc_id, seen) in enumerate(sorted(groups[k])):
            low, sub = walk(trees[k], pos, seen)
            high, top = walk(crown, at, sub)
            out.append((doc_id, own, trees[k][-1][0], crown[-1][0], h(*low, *high), top, top == crown[-1][0]))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 11, 33, 4096])
def test_append_gives_roots_and_witnesses(n):
    leaves = [bytes.fromhex(h(str(i))) for i in range(n)]
    tree = levels([x.hex() for x in leaves])
    forest = X.Forest()
    for x in leaves:
        forest.append(x)
    root = forest.close(X.height_of(n))
    assert root.hex() == tree[-1][0]
    for pos in {0, n // 2, n - 1}:
        siblings, _ = walk(tree, pos, tree[0][pos])
        assert bytes(forest.witnesses[pos]).hex() == "".join(siblings)
        assert X.fold(leaves[pos], pos, n, bytes(forest.witnesses[pos])) == root != X.fold(root, pos, n, bytes(forest.witnesses[pos])) or n == 1


def test_appended_sibling_extends_the_witnesses_before():
    forest = X.Forest()
    forest.append(b"a" * 32), forest.append(b"b" * 32)
    assert [bytes(w) for w in forest.witnesses] == [b"b" * 32, b"a" * 32]
    forest.append(b"c" * 32)
    assert [len(w) for w in forest.witnesses] == [32, 32, 0]
    forest.append(b"d" * 32)
    assert [bytes(w[32:]) for w in forest.witnesses[:2]] == [X.parent(b"c" * 32, b"d" * 32)] * 2


def test_several_blocks_and_languages(spark):
    docs = [(i * 3, f"text {i}", "en", "s", i) for i in range(2 * X.BLOCK + 5)]
    docs += [(i, "t", lang, None, None if i % 2 else 5) for i in range(40) for lang in (None, "é", "de", "z")]
    docs += [(7, "alone", "fr", "s", 1)]
    made = X.document_manifest(spark.createDataFrame(docs, SCHEMA).repartition(6), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    got = [tuple(r) for r in made.collect()]
    assert sorted(got, key=key) == sorted(brute(docs), key=key)
    assert {r[6] for r in got} == {True, False}


def test_edge_rows(spark):
    docs = edge_docs(spark)
    got = [tuple(r) for r in X.document_manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0).collect()]
    want = brute([(r[0], r[1], r[2], r[3], r[4]) for r in rows()])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert X.document_manifest(no_docs(spark)).count() == 0
    lone = X.document_manifest(docs.limit(1)).first()
    assert lone["leaf"] == lone["subroot"] == lone["root"] == lone["folded_root"] and lone["proof_sha256"] == h()
