"""WARC archives: a writer and a sequential reader, one gzip member per record.

Archives are real files in a folder that all executors share. Each task writes its own files and
returns a manifest row per file; only files of the manifest are read, so what a lost or repeated
task left behind does no harm. The reader decompresses member by member in small steps, frames
records by Content-Length and verifies block and payload digests.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import shared_folder, stored, table

ROLL_BYTES = 128 << 20
CHUNK = 1 << 16
#: Payloads shorter than this are always written in full.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that cannot be framed or whose digest is wrong."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int = 0
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _lines(fields: dict[str, str]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode("utf-8")


def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head only, with the full length."""
    http = b"HTTP/1.1 200 OK\r\n" + _lines({"Content-Type": "text/html; charset=utf-8", "Content-Length": str(size)}) + b"\r\n"
    block = http + (payload if kind == "response" else b"")
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{sha256(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": PROFILE}
    return gzip.compress(b"WARC/1.1\r\n" + _lines(fields) + b"\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def _uri_text(url: str | None) -> str:
    """A URI on one header line: line ends and outer blanks would break the framing."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A").strip()


def _fields(head: bytes) -> dict[str, str]:
    rows = (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:] if x)
    return {k.strip().lower(): v.strip() for k, _, v in rows}


class _Member:
    """The decompressed bytes of one gzip member, read in small steps."""

    def __init__(self, source: BinaryIO, rest: bytes):
        self.source, self.raw, self.out, self.z = source, rest, bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        """Another step; False at the end of the member."""
        if self.z.eof:
            return False
        if not self.raw:
            self.raw = self.source.read(CHUNK)
            if not self.raw:
                raise WarcError("the archive ends inside a record")
        try:
            self.out += self.z.decompress(self.raw, CHUNK)
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if not self.more():
                raise WarcError("no end of the header")
        return self._cut(at + len(mark))

    def exactly(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more():
                raise WarcError("the block is shorter than its Content-Length")
        return self._cut(n)

    def _cut(self, n: int) -> bytes:
        got = bytes(self.out[:n])
        del self.out[:n]
        return got

    def end(self) -> bytes:
        """The rest of the member, which must be the record's end; returns the raw bytes after it."""
        while self.more():
            pass
        if bytes(self.out) != b"\r\n\r\n":
            raise WarcError("the block is longer than its Content-Length")
        return self.raw


def read_records(source: BinaryIO, verify: bool = True) -> Iterator[Record]:
    """Records of an archive from first to last. Memory holds one record and one chunk."""
    rest, offset = b"", 0
    while rest or (rest := source.read(CHUNK)):
        member = _Member(source, rest)
        head = member.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise WarcError("no WARC version line")
        headers = _fields(head)
        block = member.exactly(int(headers["content-length"]))
        rest = member.end()
        record = Record(headers, block, offset)
        offset += 1
        http, _, payload = block.partition(b"\r\n\r\n")
        record.http, record.payload = _fields(http), payload
        if verify:
            if headers.get("warc-block-digest") != f"sha256:{sha256(block)}":
                raise WarcError(f"block digest of {headers.get('warc-record-id')}")
            if headers["warc-type"] == "response":
                if headers.get("warc-payload-digest") != f"sha256:{sha256(payload)}":
                    raise WarcError(f"payload digest of {headers.get('warc-record-id')}")
                if int(record.http["content-length"]) != len(payload):
                    raise WarcError(f"payload length of {headers.get('warc-record-id')}")
        yield record


def _open(path: str, mode: str):
    """A stream of the file system that the path names; plain paths and file: are local ones."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if mode == "r":
        return system.open_input_stream(inner, compression=None)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def _uri(folder: str) -> str:
    """``file:/x`` as ``file:///x``, which every reader of URIs takes."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        return "file://" + folder.removeprefix("file:")
    return folder


def roles(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """``id, digest, first_id`` of the pages that are revisits of an equal payload. Only identifiers
    and digests move; groups of copies are counted in the map tasks, and a hot one joins as the
    split side of the join. Rows that repeat the smallest id of their group are no revisits."""
    payload = F.coalesce(F.col(html), F.lit(""))
    narrow = stored(
        pages.filter(F.octet_length(payload) >= least).select(F.col(page_id).alias("id"), F.sha2(payload, 256).alias("digest"))
    )
    groups = narrow.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return narrow.join(groups, "digest").filter("id > first_id").select("id", "digest", "first_id").distinct()


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row of ``pages`` and return the manifest (path, records, bytes).

    A null payload is empty, a null url an empty URI. A page without id is a response that
    nothing refers to. Other columns are not written.
    """
    folder = _uri(folder)
    twins = roles(pages, page_id, html)
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).join(twins, ["id", "digest"], "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def start():
            path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            return path, _open(path, "w")

        path, out, n, size = None, None, 0, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    path, out = start()
                payload = row.html.encode("utf-8")
                first = None if pd.isna(row.first_id) else int(row.first_id)
                own = "urn:page:" + ("none:" + uuid.uuid4().hex if pd.isna(row.id) else str(int(row.id)))
                kind = "response" if first is None else "revisit"
                data = record_bytes(kind, own, _uri_text(row.url), payload, row.digest, len(payload), None if first is None else f"urn:page:{first}")
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})
                    out, n, size = None, 0, 0
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})

    rows = rows.withColumns({"id": F.col("id").cast("string"), "first_id": F.col("first_id").cast("string")})
    return stored(rows.mapInPandas(write, "path string, records long, bytes long"))


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read the archives of a manifest, one task per file at most ROLL_BYTES (and one record)
    long. Returns per record: record_id, url, record_type, payload_bytes, payload_digest,
    refers_to, path, offset (its number in the file), and on request the payload."""
    schema = "record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, path string, offset long"
    schema += ", payload binary" if with_payload else ""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, records in zip(batch["path"], batch["records"]):
                rows, held, seen = [], 0, 0
                with _open(path, "r") as source:
                    for r in read_records(source):
                        seen += 1
                        h = r.headers
                        refers = h.get("warc-refers-to")
                        rows.append((
                            h["warc-record-id"].strip("<>"), h["warc-target-uri"], h["warc-type"], int(r.http["content-length"]),
                            h["warc-payload-digest"].removeprefix("sha256:"), refers and refers.strip("<>"), path, r.offset,
                        ) + ((r.payload,) if with_payload else ()))
                        held += len(r.payload) if with_payload else 0
                        if len(rows) >= 5000 or held >= 32 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if seen != records:
                    raise WarcError(f"{path} has {seen} records, its manifest {records}")
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in schema.split(", ")]
    files = manifest.select("path", "records").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")
    return files.mapInPandas(read, schema)


def _page(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_folder(spark))
    return read_archives(manifest).select(
        _page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        _page(F.col("refers_to")).alias("refers_to"),
    )


_ORACLE = f"""
    WITH p AS (
        SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
    ), f AS (
        SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
    )
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id > first_id THEN first_id END AS refers_to
    FROM f"""

QUERIES = {"op3_warc": op3_warc}
ORACLES = {"op3_warc": _ORACLE}
