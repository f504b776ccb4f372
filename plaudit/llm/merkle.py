"""Merkle manifest of a dataset: a root, and per row the proof that the row is part of it.

Every row is a leaf. The leaves of a group (a language) form a tree in the order of their ids, and
the roots of the groups form a tree again. A tree is built by streaming aligned append: blocks of
BLOCK consecutive leaves are appended one by one, and a subtree that is complete merges with its
left sibling of the same height. Each leaf below carries a partial witness, the siblings met so
far; the merge extends the witnesses of both halves. The roots of the blocks are appended in the
same way one storey up, and their witnesses extend those of all leaves of the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plaudit.llm.common import bounded_batches, once, stored, table

#: log2 of the leaves of a block. A task holds one block and its witnesses at a time.
LEVELS = 12
BLOCK = 1 << LEVELS
#: The fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def parent(*children: bytes) -> bytes:
    """Digest of a run of nodes: their digests, as hex text, one after the other."""
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


class Forest:
    """Streaming append into the subtrees of one block, with a witness per leaf."""

    def __init__(self):
        self.open: list[tuple[int, bytes, list[bytearray]]] = []
        self.witnesses: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        mine = bytearray()
        self.witnesses.append(mine)
        self.open.append((0, digest, [mine]))
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._merge()

    def _merge(self) -> None:
        (_, right, below_right), (height, left, below_left) = self.open.pop(), self.open.pop()
        for w in below_left:
            w += right
        for w in below_right:
            w += left
        self.open.append((height + 1, parent(left, right), below_left + below_right))

    def close(self, height: int) -> bytes:
        """The root at the given height. A last node without sibling is hashed alone."""
        while len(self.open) > 1 or self.open[0][0] < height:
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._merge()
            else:
                level, digest, below = self.open.pop()
                self.open.append((level + 1, parent(digest), below))
        return self.open[0][1]


def height_of(n: int) -> int:
    """Storeys of a tree of ``n`` leaves, within a block."""
    return LEVELS if n > BLOCK else max(n - 1, 0).bit_length()


def fold(digest: bytes, pos: int, n: int, witness: bytes) -> bytes:
    """The root that a leaf and its witness give; ``pos`` and ``n`` say which levels have a
    sibling and on which side it stands."""
    at = 0
    while n > 1:
        if pos ^ 1 < n:
            sibling = witness[at : at + 32]
            at += 32
            digest = parent(sibling, digest) if pos & 1 else parent(digest, sibling)
        else:
            digest = parent(digest)
        pos, n = pos >> 1, n + 1 >> 1
    return digest


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos`` (from 0) in the given order within ``key`` and ``n``, the rows of the key.

    Ranges of the order are tasks, so a key of any size is spread over many; their sizes, a row
    per task and key, give the offsets. Rows alike in all of ``order`` are told apart by a number,
    so that they spread as well.
    """
    numbered = stored(rows.withColumn("uid", F.monotonically_increasing_id()))
    ranged = numbered.repartitionByRange("key", *order, "uid").sortWithinPartitions("key", *order, "uid")
    parts = stored(ranged.withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"))
    mine = W.partitionBy("key")
    offsets = sizes.select(
        "key", "part",
        F.coalesce(F.sum("c").over(mine.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("c").over(mine).alias("n"),
    )
    local = F.row_number().over(W.partitionBy("key", "part").orderBy(*order, "uid")) - 1
    placed = parts.withColumn("local", local).join(offsets, ["key", "part"])
    return placed.withColumn("pos", F.col("local") + F.col("offset")).drop("local", "offset", "part", "uid")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Adds ``witness``, inside its block, to every node; ``top`` is the root of the block, on its
    first node. Other columns pass through."""
    schema = T.StructType([*nodes.schema, T.StructField("witness", T.BinaryType()), T.StructField("top", T.BinaryType())])
    target = to_arrow_schema(schema)

    def closed(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        forest = Forest()
        for digest in rows.column("digest").to_pylist():
            forest.append(digest)
        top = forest.close(height_of(rows.column("n")[0].as_py()))
        rows = rows.append_column("witness", pa.array([bytes(w) for w in forest.witnesses], pa.binary()))
        rows = rows.append_column("top", pa.array([top] + [None] * (len(rows) - 1), pa.binary()))
        return rows.cast(target).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], None
        for batch in batches:
            blocks = list(zip(batch.column("key").to_pylist(), [p >> LEVELS for p in batch.column("pos").to_pylist()]))
            starts = [0, *(i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1]), len(blocks)]
            for i, j in zip(starts, starts[1:]):
                if i == j:
                    continue
                if parts and blocks[i] != held:
                    yield from closed(parts)
                    parts = []
                held = blocks[i]
                parts.append(batch.slice(i, j - i))
        if parts:
            yield from closed(parts)

    dealt = nodes.repartition("key", F.shiftright("pos", LEVELS)).sortWithinPartitions("key", "pos")
    return dealt.mapInArrow(run, schema)


def witnesses(nodes: DataFrame, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``key, pos, n, digest, witness, subroot`` of every node (key, pos, n, digest), and what
    ``above`` returns per key for the roots (key, digest).

    One round per storey of blocks, so the number of rounds is log n / LEVELS. No key is joined
    with more than BLOCK rows.
    """
    made = stored(_blocks(nodes))
    tops = made.filter("top IS NOT NULL")
    bare = made.drop("top")
    if tops.filter(F.col("n") > BLOCK).isEmpty():
        roots = tops.select("key", F.col("top").alias("digest"))
        found = roots.withColumnRenamed("digest", "subroot")
        if above is not None:
            found = found.join(above(roots), "key")
        return bare.join(found, "key")
    ups = tops.select("key", F.shiftright("pos", LEVELS).alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))
    upper = witnesses(ups, above).drop("n", "digest").withColumnsRenamed({"pos": "block", "witness": "more", "key": "upper_key"})
    met = bare.join(upper, (F.col("key") == F.col("upper_key")) & (F.shiftright("pos", LEVELS) == F.col("block")))
    return met.withColumn("witness", F.concat("witness", "more")).drop("upper_key", "block", "more")


def manifest(rows: DataFrame, order: list[str]) -> DataFrame:
    """Trees of the groups and the tree of their roots.

    ``rows`` has key (never null), digest, and any columns that pass through; inside a key it stands
    in the given order, nulls first. Rows alike in all of the order must have equal digests. Adds
    pos, n, witness, subroot, and top_pos, top_n, top_witness, root of the second tree, whose leaves
    are ordered by key. An empty table gives an empty manifest; a lone leaf is its own root.
    """
    bounded_batches(rows.sparkSession)

    def groups(roots: DataFrame) -> DataFrame:
        ranked = positions(roots.select(F.lit("").alias("key"), "digest", F.col("key").alias("of")), ["of"])
        tree = witnesses(ranked).select(
            F.col("of").alias("key"), F.col("pos").alias("top_pos"), F.col("n").alias("top_n"),
            F.col("witness").alias("top_witness"), F.col("subroot").alias("root"),
        )
        return stored(tree)

    return witnesses(positions(rows, order), groups)


def folded_root(digest: str) -> Column:
    """The root that a column of leaf digests and the witnesses of a manifest give."""

    @F.pandas_udf("binary")
    def folded(d: pd.Series, pos: pd.Series, n: pd.Series, w: pd.Series, top_pos: pd.Series, top_n: pd.Series, top_w: pd.Series) -> pd.Series:
        rows = zip(d, pos, n, w, top_pos, top_n, top_w)
        return pd.Series([fold(fold(bytes(a), p, k, bytes(x)), q, m, bytes(y)) for a, p, k, x, q, m, y in rows], dtype=object)

    return folded(digest, "pos", "n", "witness", "top_pos", "top_n", "top_witness")


def document_leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """``key, doc_id, digest, seen`` of every document: its leaf, and the leaf after ``n_chars`` grew
    by one where ``changed`` holds (a null number stays).

    The key orders languages, null first, then by bytes. Other columns are not read.
    """
    own = docs.select(*FIELDS, F.coalesce(F.lit(False) if changed is None else changed, F.lit(False)).alias("changed"))
    own = once(own, "leaf", leaf_digest([F.col(c) for c in FIELDS]))
    more = leaf_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    key = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("key")
    seen = F.when(F.col("changed"), more).otherwise(F.col("leaf"))
    return own.select(key, "doc_id", F.unhex("leaf").alias("digest"), F.unhex(seen).alias("seen"))


def document_manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """The proof of every document, and whether what is ``seen`` of it now agrees with the root.

    Returns doc_id, leaf, subroot, root, proof_sha256 (of all siblings, as hex text, from the leaf
    up), folded_root and verified. A null in any field is a part of the leaf like another value;
    documents without id stand before the others of their language; rows with one id follow each
    other by their leaves, and rows alike in all fields are leaves of their own, each with the proof
    of its place. Texts may be of any length, as only digests leave the scan. An empty table gives an
    empty result; columns of other names, whatever they are, are not read.
    """
    made = manifest(stored(document_leaves(docs, changed)), ["doc_id", "digest"])
    text = lambda c: F.lower(F.hex(c))
    proof = F.sha2(F.concat(text("witness"), text("top_witness")), 256)
    full = once(made, "folded", folded_root("seen"))
    return full.select(
        "doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        proof.alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """All documents; those whose crc32 of the id divides by 7 are seen with one character more."""
    return document_manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


#: Unsigned crc32 of a decimal number; eight steps a byte.
_STEP = "CASE WHEN {x} % 2 = 1 THEN xor({x} // 2, 3988292384) ELSE {x} // 2 END"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: " + _STEP.format(x="x") + ")), 4294967295)"
)


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


_ORACLE = f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, lang, sha256({' || '.join(_field(c) for c in FIELDS)}) AS leaf,
               CASE WHEN {_CRC} % 7 = 0 THEN sha256({' || '.join(_field('n_chars + 1' if c == 'n_chars' else c) for c in FIELDS)})
                    ELSE sha256({' || '.join(_field(c) for c in FIELDS)}) END AS seen
        FROM documents
    ), leaves AS (
        SELECT *, coalesce('1' || lang, '0') AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
    ), tree AS (
        SELECT k, 0 AS level, pos AS idx, leaf AS h, count(*) OVER (PARTITION BY k) AS n FROM leaves
        UNION ALL
        SELECT k, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY k, level, idx // 2, n
    ), subs AS (
        SELECT k, h AS subroot, level AS height, row_number() OVER (ORDER BY k) - 1 AS kpos FROM tree WHERE n = 1
    ), crown AS (
        SELECT 0 AS level, kpos AS idx, subroot AS h, count(*) OVER () AS n FROM subs
        UNION ALL
        SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM crown WHERE n > 1 GROUP BY level, idx // 2, n
    ), nodes AS (
        SELECT k, level, idx, h, n FROM tree WHERE n > 1
        UNION ALL
        SELECT s.k, s.height + c.level, c.idx, c.h, c.n FROM crown c, subs s WHERE c.n > 1
    ), places AS (
        SELECT l.k, l.pos, t.level, l.pos // CAST(power(2, t.level) AS BIGINT) AS idx
        FROM leaves l JOIN (SELECT DISTINCT k, level FROM tree WHERE n > 1) t ON t.k = l.k
        UNION ALL
        SELECT l.k, l.pos, s.height + c.level, s.kpos // CAST(power(2, c.level) AS BIGINT)
        FROM leaves l JOIN subs s ON s.k = l.k, (SELECT DISTINCT level FROM crown WHERE n > 1) c
    ), siblings AS (
        SELECT p.k, p.pos, p.level, p.idx, x.h FROM places p LEFT JOIN nodes x ON x.k = p.k AND x.level = p.level AND x.idx = xor(p.idx, 1)
    ), folds AS (
        SELECT k, pos, 0 AS level, seen AS h FROM leaves
        UNION ALL
        SELECT f.k, f.pos, f.level + 1,
               sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.idx % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END)
        FROM folds f JOIN siblings s ON s.k = f.k AND s.pos = f.pos AND s.level = f.level
    ), proofs AS (
        SELECT k, pos, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256 FROM siblings GROUP BY k, pos
    ), ends AS (
        SELECT k, pos, arg_max(h, level) AS folded_root FROM folds GROUP BY k, pos
    ), top AS (SELECT h AS root FROM crown WHERE n = 1)
    SELECT l.doc_id, l.leaf, s.subroot, top.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = top.root AS verified
    FROM leaves l JOIN subs s ON s.k = l.k LEFT JOIN proofs p ON p.k = l.k AND p.pos = l.pos JOIN ends e ON e.k = l.k AND e.pos = l.pos, top"""

QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op13_merkle_manifest": _ORACLE}
