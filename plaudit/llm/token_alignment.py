"""Alignment of two tokenizers over the same texts, and how often their tokens meet.

Both tokenizers cut the bytes of a text. A dictionary of each leads from the byte at which a token
ends to the token's index; the ends that both have, sorted, cut both id lists into groups, and every
A token of a group is linked with every B token of it. Corpus-wide counts of linked id pairs come
from Spark; the most frequent pairs, a bounded table, are looked up in the scan and the others joined.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import bounded_batches, stored, table

#: Folder of the vocabulary files, unless given.
FOLDER = os.environ.get("PLAUDIT_TOKENIZERS", "/opt/tokenizers")
#: A pair of ids is one number, a * SHIFT + b.
SHIFT = 1 << 20
#: Pairs whose counts every task holds; all others are joined.
FREQUENT = 1 << 18
#: Groups of more links than that are counted by distinct ids and not link by link.
LARGE = 1 << 12


class Cuts:
    """Where the groups of a text end in both id lists (exclusive indexes), and their sizes."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        self.a_sizes, self.b_sizes = [x - np.concatenate([[0], x[:-1]]) for x in (a, b)]


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> Cuts:
    """The ends that both lists have, by a dictionary of each and the hash-set intersection of
    their keys. Of tokens that end in one place, the last counts."""
    a_at = dict(zip(a_ends.tolist(), range(1, len(a_ends) + 1)))
    b_at = dict(zip(b_ends.tolist(), range(1, len(b_ends) + 1)))
    cuts = sorted(a_at.keys() & b_at.keys())
    return Cuts(*[np.fromiter(map(at.__getitem__, cuts), np.int64, len(cuts)) for at in (a_at, b_at)])


def linked_pairs(a: np.ndarray, b: np.ndarray, cuts: Cuts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked id pairs, ascending, with the number of their links."""
    ga, gb = cuts.a_sizes, cuts.b_sizes
    small = ga * gb <= LARGE
    width = np.repeat(np.where(small, gb, 0), ga)  # links of every A token
    first = np.repeat(cuts.b - gb, ga)
    left = np.repeat(a[: len(width)], width)
    right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
    pairs, times = np.unique(left * SHIFT + b[right], return_counts=True)
    if small.all():
        return pairs, times
    parts = [(pairs, times)]
    for g in np.flatnonzero(~small):
        ours, x = np.unique(a[cuts.a[g] - ga[g] : cuts.a[g]], return_counts=True)
        theirs, y = np.unique(b[cuts.b[g] - gb[g] : cuts.b[g]], return_counts=True)
        parts.append(((ours[:, None] * SHIFT + theirs).ravel(), (x[:, None] * y).ravel()))
    pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    times = np.zeros(len(pairs), np.int64)
    np.add.at(times, at, np.concatenate([t for _, t in parts]))
    return pairs, times


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers of a task, with the bytes and the written form of every id.

    A is read from its vocabulary file and run by the faster library for the same kind, ids being
    the ranks of its merges; its special tokens are left out, so their strings are plain text.
    """

    def __init__(self, folder: str, a_file: str, b_file: str):
        import sentencepiece
        import tiktoken

        letters = byte_of_char()
        with open(f"{folder}/{a_file}", encoding="utf-8") as f:
            given = json.load(f)
        special = {t["content"] for t in given["added_tokens"] if t["special"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in given["model"]["vocab"].items() if token not in special}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.a = tiktoken.Encoding(a_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        #: The pattern leaves out no character; with all single bytes, A gives back every text.
        self.a_exact = all(bytes([x]) in ranks for x in range(256))
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b_file}")
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_lengths, self.b_lengths = [np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes)]
        if max(len(self.a_bytes), len(self.b_bytes)) > SHIFT:
            raise ValueError(f"vocabularies of more than {SHIFT} ids")
        #: Every id with the sign that follows it: inside a group and at its end, first all of A.
        self.shown = [f"{i}{sign}" for i in range(len(self.a_bytes)) for sign in ",|"]
        self.shown += [f"{i}{sign}" for i in range(len(self.b_bytes)) for sign in ",;"]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def written(self, a: np.ndarray, b: np.ndarray, cuts: Cuts) -> str:
        """The groups as text, ``a1,a2|b1;a3|b2,b3``."""
        ga, gb = cuts.a_sizes, cuts.b_sizes
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[cuts.a - 1] = b_last[cuts.b - 1] = 1
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(cuts.b - gb, ga)] = 2 * a + a_last
        order[np.arange(len(b)) + np.repeat(cuts.a, gb)] = 2 * (len(self.a_bytes) + b) + b_last
        return "".join(map(self.shown.__getitem__, order.tolist()))[:-1]

    def document(self, text: str | None) -> tuple:
        """n_a, n_b, n_groups, n_links, hash of the groups, linked pairs and their links."""
        nothing = (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))
        if not text:
            return nothing
        data = (" " + text).encode()
        a, b = self.a.encode_to_numpy(" " + text).astype(np.int64), np.array(self.b.encode(text), np.int64)
        a_ends, b_ends = self.a_lengths[a].cumsum(), self.b_lengths[b].cumsum()
        if not len(b) or not a_ends[-1] == b_ends[-1] == len(data):
            return nothing
        if b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            return nothing
        if not self.a_exact and b"".join(map(self.a_bytes.__getitem__, a.tolist())) != data:
            return nothing
        cuts = common_ends(a_ends, b_ends)
        pairs, times = linked_pairs(a, b, cuts)
        digest = hashlib.sha256(self.written(a, b, cuts).encode()).hexdigest()
        return len(a), len(b), len(cuts.a), int(cuts.a_sizes @ cuts.b_sizes), digest, pairs, times


@lru_cache(maxsize=1)
def tokenizers(folder: str, a_file: str, b_file: str) -> Tokenizers:
    return Tokenizers(folder, a_file, b_file)


ALIGNED = "doc_id long, uid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def align_documents(docs: DataFrame, folder: str = FOLDER, a_file: str = "byte_bpe_50k.json", b_file: str = "piece_bpe_32k.model") -> DataFrame:
    """A row per document: its counts, the hash of its groups, and the linked id pairs with the
    number of their links. ``uid`` tells rows alike in id and text apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(folder, a_file, b_file)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            made = [both.document(t.as_py()) for t in batch.column("text")]
            plain = list(zip(*[m[:5] for m in made])) or [[]] * 5
            ids = pa.array(range(uid, uid + len(made)), pa.int64())
            uid += len(made)
            columns = [batch.column("doc_id"), ids, *[pa.array(c, pa.int64()) for c in plain[:4]], pa.array(plain[4], pa.string())]
            columns += [pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ALIGNED.split(", ")])

    bounded_batches(docs.sparkSession, 4)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(made: DataFrame) -> DataFrame:
    """``pair, n, best``: in how many documents a pair is linked, and whether that is the most of
    its A id, ties included. The table of A ids is no longer than the vocabulary."""
    n = made.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    n = stored(n.withColumn("a", F.floor(F.col("pair") / SHIFT).cast("int")))
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, folder: str = FOLDER, a_file: str = "byte_bpe_50k.json", b_file: str = "piece_bpe_32k.model") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose bytes a tokenizer does not give back, have zeros and an
    empty hash. Rows alike in id and text are documents of their own and count each; ids may be null.
    Texts of any length are read whole; work and memory go with the tokens of one text (within a
    group with the product of its distinct ids). An empty table gives an empty result; other columns
    are not read.

    Every task gets the FREQUENT most frequent pairs with their counts, sorted (ties by number):
    that table, 17 bytes a pair, does not grow with the corpus. What it does not hold leaves the
    scan as rows (document, pair, links) and meets the other counts in a join, where no pair is hot.
    """
    spark = docs.sparkSession
    made = stored(align_documents(docs, folder, a_file, b_file))
    counts = stored(pair_counts(made))
    top = counts.orderBy(F.desc("n"), "pair").limit(FREQUENT).toArrow().sort_by("pair")
    held = spark.sparkContext.broadcast([top.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")])
    plain = ["doc_id", "uid", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [batch.column(c) for c in ("pairs", "times")]
            pairs, times = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
            row = np.repeat(np.arange(batch.num_rows), np.asarray(lists[0].value_lengths()))
            at = np.searchsorted(keys, pairs)
            at[at == len(keys)] = 0
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            links = np.where(hit, times, 0)
            sums = np.zeros(batch.num_rows, np.int64)
            good = np.zeros(batch.num_rows, np.int64)
            if len(keys):
                np.add.at(sums, row, links * n[at])
                np.add.at(good, row, links * best[at])
            cuts = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))])
            left = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x[~hit], pa.int64())) for x in (pairs, times)]
            columns = [*[batch.column(c) for c in plain], pa.array(good), pa.array(sums), *left]
            yield pa.RecordBatch.from_arrays(columns, names=[*plain, "n_best", "count_sum", "pairs", "times"])

    schema = ALIGNED.replace("pairs", "n_best long, count_sum long, pairs")
    most = stored(made.mapInArrow(run, schema))
    rare = most.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", "x.pairs", "x.times")
    met = rare.join(counts.withColumnRenamed("pair", "pairs"), "pairs")
    rest = met.groupBy("uid").agg(
        F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best")
    )
    full = most.drop("pairs", "times").join(rest, "uid", "left")
    return full.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLES: dict[str, str] = {}
