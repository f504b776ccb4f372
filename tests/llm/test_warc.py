import gzip
import io

import pytest

from plaudit.llm import warc as X
from plaudit.llm.common import shared_folder

HTML = "<p>" + "text é " * 30 + "</p>"


def archive(*payloads):
    return b"".join(
        X.record_bytes("response", f"urn:page:{i}", "http://a/", p, X.sha256(p), len(p), None) for i, p in enumerate(payloads)
    )


def test_one_gzip_member_per_record():
    data = archive(b"a", b"", b"x" * 300_000)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3
    got = list(X.read_records(io.BytesIO(data)))
    assert [r.payload for r in got] == [b"a", b"", b"x" * 300_000]
    assert [r.headers["warc-record-id"] for r in got] == [f"<urn:page:{i}>" for i in range(3)]


def test_payload_may_hold_what_looks_like_a_record():
    tricky = b"\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n\r\n\r\n"
    assert [r.payload for r in X.read_records(io.BytesIO(archive(tricky, tricky)))] == [tricky, tricky]


def test_damage_is_found():
    plain = gzip.decompress(archive(b"hello world"))
    for bad in (plain.replace(b"hello", b"jello"), plain.replace(b"Content-Length: 11", b"Content-Length: 12"), plain[:-6], plain + b"x"):
        with pytest.raises(X.WarcError):
            list(X.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(X.WarcError):
        list(X.read_records(io.BytesIO(archive(b"hello")[:-9])))
    with pytest.raises(X.WarcError):
        list(X.read_records(io.BytesIO(b"no archive")))


def test_round_trip(spark):
    rows = [
        (3, "http://b/", HTML), (1, "http://a/\r\nX: y", HTML), (2, None, HTML), (4, "http://c/", None), (5, "http://d/", ""),
        (6, "http://e/", "short"), (7, "http://e/", "short"), (None, "http://n/", HTML), (8, "u", "long " * 200_000), (1, "http://a2/", HTML),
        (1, "http://a3/", "other " * 40),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS first_id", "2 AS id", "3 AS digest")
    manifest = X.write_archives(pages.repartition(3), shared_folder(spark))
    got = X.read_archives(manifest, with_payload=True).toPandas()
    assert manifest.selectExpr("sum(records)").first()[0] == len(rows) == len(got)
    kinds = sorted(zip(got["record_id"].str.replace(r"none:.*", "none", regex=True), got["record_type"], got["refers_to"].fillna("")))
    first = "urn:page:1"
    assert kinds == sorted([
        ("urn:page:3", "revisit", first), (first, "response", ""), ("urn:page:2", "revisit", first), ("urn:page:4", "response", ""),
        ("urn:page:5", "response", ""), ("urn:page:6", "response", ""), ("urn:page:7", "response", ""), ("urn:page:none", "response", ""),
        ("urn:page:8", "response", ""), (first, "response", ""), (first, "response", ""),
    ])
    by_size = {(r.record_id, r.payload_bytes, r.payload_digest) for r in got.itertuples() if "none" not in r.record_id}
    want = {(f"urn:page:{i}", len((h or "").encode()), X.sha256((h or "").encode())) for i, _, h in rows if i}
    assert by_size == want
    full = got[got["record_type"] == "response"]
    assert all(X.sha256(bytes(p)) == d for p, d in zip(full["payload"], full["payload_digest"]))


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert X.read_archives(X.write_archives(pages, shared_folder(spark))).count() == 0
