import base64
import hashlib
import re

import numpy as np
import xxhash
from cases import docs_of, edge_docs, no_docs
from pyspark.sql import functions as F

from plaudit.llm import fingerprints as P


def by_hand(text):
    exact = np.zeros(8, object)
    for p in text.split("\n"):
        d = hashlib.sha256(p.encode()).digest()
        exact = (exact + np.array([int.from_bytes(d[4 * i : 4 * i + 4], "big") for i in range(8)], object)) % (1 << 32)
    signs = np.zeros(128, int)
    for c in re.split(r"\n|(?<=[.!?;,|])[ \t]+", text):
        if c:
            for half, seed in enumerate((1, 2)):
                h = xxhash.xxh64_intdigest(c.encode(), 42)
                h = xxh_int(seed, h)
                for j in range(32):
                    signs[64 * half + 2 * j] += 2 * (h >> j & 1) - 1
                    signs[64 * half + 2 * j + 1] += 2 * (h >> (j + 32) & 1) - 1
    return exact.tolist(), ((signs + 32768) % 65536 - 32768).tolist()


def xxh_int(value, seed):
    """Spark hashes a further int with the hash so far as its seed."""
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little"), seed)


TEXTS = ["One. Two, three\nfour | five! six", "", "\n\n", "é 漢字 😀. x", "same. same. same. same."]


def test_vector_by_hand(spark):
    rows = docs_of(spark, TEXTS).select("text", P.vector(F.col("text")).alias("v")).collect()
    for r in rows:
        exact, signs = by_hand(r.text)
        assert list(r.v.exact) == exact and list(r.v.signs) == signs


def test_order_insertion_and_deletion(spark):
    df = spark.sql("SELECT 'a b. c' AS p, 'd, e' AS q, 'a b. c\nd, e' AS pq, 'd, e\na b. c' AS qp")
    v = {c: P.vector(F.col(c)) for c in df.columns}
    row = df.select(
        (v["pq"] == v["qp"]).alias("order"), (P.inserted(v["p"], F.col("q")) == v["pq"]).alias("insert"),
        (P.deleted(v["qp"], F.col("p")) == v["q"]).alias("delete"), (v["p"] == v["q"]).alias("differ"),
    ).first()
    assert row.order and row.insert and row.delete and not row.differ


def test_encoding_and_likeness(spark):
    long = ". ".join(f"w{i} x{i * i}" for i in range(200))
    half = ". ".join(f"w{i} x{i * i}" for i in range(100)) + ". " + ". ".join(f"v{i} y{i}" for i in range(100))
    df = spark.createDataFrame([(long, half, "other. words")], "a string, b string, c string")
    v = {c: P.vector(F.col(c)) for c in "abc"}
    r = df.select(P.encoded(v["a"]).alias("e"), v["a"].alias("v"), P.likeness(v["a"], v["a"]).alias("same"), P.likeness(v["a"], v["b"]).alias("half"), P.likeness(v["a"], v["c"]).alias("none")).first()
    raw = base64.b64decode(r.e)
    assert len(raw) == 8 * 4 + 128 * 2
    assert [int.from_bytes(raw[4 * i : 4 * i + 4], "big") for i in range(8)] == list(r.v.exact)
    assert np.frombuffer(raw[32:], ">i2").tolist() == list(r.v.signs)
    assert r.same == 1 and 0.25 < r.half < 0.75 and r.none < 0.3


def test_next_and_edited_text(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    texts = ["x" * n + f". {n} é😀" for n in (9, 0, 3, 200, 1, 2, 8, 30, 4, 5)]
    ids = [50, -3, 7, 8, 9, 1000, 2000, 51, 52, 10**12]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r for r in P.fingerprints(docs).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(ids)
    text = dict(zip(ids, texts))
    for i, d in enumerate(order):
        t, h = text[d], len(text[d]) // 2
        edited = t[: len(t) - h] + text[order[(i + 1) % len(order)]][:h]
        assert rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[d].n_chars == len(t) and list(rows[d].e.signs) == by_hand(edited)[1]
        assert list(rows[d].next_v.exact) == by_hand(text[order[(i + 1) % len(order)]])[0]


def test_edges(spark):
    docs = edge_docs(spark)
    rows = P.fingerprints(docs).toPandas()
    assert len(rows) == docs.count() and rows["n_chars"].notna().all() and rows["edited_sha256"].notna().all()
    assert rows["doc_id"].isna().sum() == 2
    assert P.fingerprints(no_docs(spark)).count() == 0
    one = P.fingerprints(docs_of(spark, ["abcd"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = P.op5_fingerprints(spark, sf).toPandas()
    texts = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")["text"]
    kinds = rows.set_index("doc_id")["fingerprint"].groupby(texts).nunique()
    assert (kinds == 1).all() and rows["fingerprint"].nunique() == texts.nunique()
    assert rows["near_edited"].mean() > 0.35 and rows["near_next"].mean() < 0.15
    assert rows[["near_edited", "near_next"]].stack().between(0, 1).all()
