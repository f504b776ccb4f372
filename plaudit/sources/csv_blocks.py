"""CSV files with line breaks inside quotes, each read by many tasks.

Whether a block of a file begins inside quotes depends on the number of quotes before it. So the
lines are stored once as chunks with their number of quotes; sums over the blocks of a file say
where the open blocks are; then every chunk is cut into records by itself. Only records that lie
across the end of a chunk are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.operators.scale import bounded_batches, stable_copy

#: Text of a chunk, whole lines of one block; a longer line is a chunk of its own.
CHUNK_BYTES = 32 << 10
_CHUNK = "file long, block long, chunk int, odd boolean, quotes long, text string"
_EDGE = "file long, block long, chunk int, part int, head boolean, title boolean, text string"


def _to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines, in file order within a block, as chunks; ``odd`` is the parity of the quotes before
    the chunk in its block."""
    at, odd, chunk = None, 0, 0
    for batch in batches:
        value = batch.column("value")
        file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
        quotes = pc.count_substring(value, pattern='"').to_numpy()
        size = np.cumsum(pc.binary_length(value).to_numpy().astype(np.int64)) // CHUNK_BYTES
        change = (np.diff(file) != 0) | (np.diff(block) != 0) | (np.diff(size) != 0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(value)]
        lines, rows = value.to_pylist(), []
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if at != (file[a], block[a]):
                at, odd, chunk = (file[a], block[a]), 0, 0
            n = int(quotes[a:b].sum())
            rows.append((int(file[a]), int(block[a]), chunk, odd == 1, n, "\n".join(lines[a:b])))
            odd, chunk = (odd + n) % 2, chunk + 1
        if rows:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string()]
            names = ["file", "block", "chunk", "odd", "quotes", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def cut_records(data: bytes, opened: bool) -> tuple[list[bytes], bool]:
    """The text cut at the line breaks outside quotes, and whether it ends inside quotes. The
    first piece belongs to an earlier record if it begins inside quotes (``opened``)."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.cumsum(raw == ord('"')) + opened
    breaks = np.flatnonzero(raw == ord("\n"))
    ends = breaks[inside[breaks] % 2 == 0].tolist() if len(raw) else []
    pieces = [data[a:b] for a, b in zip([0, *[e + 1 for e in ends]], [*ends, len(data)])]
    return pieces, bool(inside[-1] % 2) if len(raw) else opened


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie within one chunk, without the title of a file."""
    for batch in batches:
        out = []
        opened, title = batch.column("opened").to_pylist(), batch.column("title").to_pylist()
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            pieces, still = cut_records(text, opened[i])
            out += pieces[int(opened[i] or title[i]) : len(pieces) - int(still)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["record"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces at the ends of chunks: a head begins a record, others go on with one."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            pieces, still = cut_records(r["text"].encode("utf-8"), r["opened"])
            key = (r["file"], r["block"], r["chunk"])
            if r["opened"]:
                rows.append((*key, 0, False, False, pieces[0].decode("utf-8")))
            if still and not (r["opened"] and len(pieces) == 1):
                rows.append((*key, 1, True, r["title"] and len(pieces) == 1, pieces[-1].decode("utf-8")))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
        columns = list(zip(*rows)) or [()] * len(types)
        names = ["file", "block", "chunk", "part", "head", "title", "text"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``record``: one row per CSV record of all files under ``path``, line breaks in quotes kept.

    Quotes inside a quoted field must be doubled, and a field that is not quoted holds none, as
    CSV writers do it; a quote that is never closed makes the rest of its file one record. Empty
    lines between records are no records. The text is stored once, in the shared folder. The open
    blocks, 8 bytes for each block of ``spark.sql.files.maxPartitionBytes``, are broadcast. Python
    gets batches bounded by bytes.
    """
    bounded_batches(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    chunks = stable_copy(lines.mapInArrow(_to_chunks, _CHUNK))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = chunks.groupBy("file", "block").agg(F.sum("quotes").alias("n"))
    opened = blocks.withColumn("before", F.sum("n").over(earlier)).filter(F.col("before") % 2 == 1)
    flags = F.broadcast(opened.select(F.xxhash64("file", "block").alias("__open")))
    met = chunks.join(flags, F.xxhash64("file", "block") == F.col("__open"), "left")
    first = (F.col("block") == 0) & (F.col("chunk") == 0) & F.lit(header)
    placed = met.withColumn("opened", F.col("__open").isNotNull() != F.col("odd")).withColumn("title", first)
    whole = placed.select("opened", "title", "text").mapInArrow(_whole, "record string")
    across = placed.filter(F.col("opened") | (F.col("quotes") % 2 == 1))
    edges = across.select("file", "block", "chunk", "opened", "title", "text").mapInArrow(_edges, _EDGE)
    met_edges = whole.union(_joined(stable_copy(edges)))
    record = F.regexp_replace("record", r"\r\z", "")
    return met_edges.select(record.alias("record")).filter("record != ''")


def _joined(edges: DataFrame) -> DataFrame:
    """Records put together from their pieces. Heads are numbered inside each block, and the heads
    of the blocks before (one row per block) are added, so no task holds all pieces of a file."""
    begins = F.col("head").cast("int")
    here = W.partitionBy("file", "block").orderBy("chunk", "part")
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = edges.groupBy("file", "block").agg(F.sum(begins).alias("__heads"))
    before = blocks.select("file", "block", F.coalesce(F.sum("__heads").over(earlier), F.lit(0)).alias("__before"))
    numbered = edges.withColumn("__no", F.sum(begins).over(here)).join(before, ["file", "block"])
    pieces = F.array_sort(F.collect_list(F.struct("block", "chunk", "part", "text")))
    whole = numbered.groupBy("file", (F.col("__no") + F.col("__before")).alias("no")).agg(
        F.max("title").alias("title"), pieces.alias("pieces")
    )
    return whole.filter(~F.col("title")).select(F.concat_ws("\n", "pieces.text").alias("record"))


def read_csv_blocks(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """The files as a table: what the reader with ``multiLine`` gives, but a large file is read by
    many tasks."""
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    row = F.from_csv("record", ddl, options)
    return csv_records(spark, path, header).select(row.alias("r")).select("r.*")
