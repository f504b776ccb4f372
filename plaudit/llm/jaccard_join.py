"""N-gram Jaccard self-join by chosen paths, with exact verification.

Documents are sets of word 5-grams. A run puts a set into a bucket for each token that it samples,
about ``width`` of them, by a hash that all sets share; a bucket with more than ``limit`` sets is
split again on the tokens of the next level, down to ``levels`` of them, unless its sets are so
alike that splitting does not part them. In a bucket, small sketches tell which sets may be
similar. Runs repeat, all in one pass, until the chance to miss a pair at the threshold is below
1 - ``recall``. The candidates form groups, inside which every pair is compared exactly, in tiles;
so links are counted without a row per pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit.llm.common import bounded_batches, one_per_key, stored, table, text_of

#: Key of documents without an id, which come last.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class JoinConfig:
    """``words`` per gram and ``threshold`` define the links; ``width``, ``levels``, ``limit``
    and ``recall`` the search. ``sketch`` is the number of smallest hashes kept of a set, and
    ``suspect`` the estimate from which a pair is a candidate. A bucket that cannot be split is
    dealt into chunks of about ``chunk`` sets, and every two chunks are compared (``pivots`` has no
    effect any more); whether it can is judged by ``judges`` of its sets before it is tried. A tile holds at
    most about ``tile`` sets and ``tile_tokens`` tokens."""

    words: int = 5
    threshold: float = 0.8
    width: float = 2.0
    levels: int = 3
    limit: int = 64
    recall: float = 0.999
    sketch: int = 64
    suspect: float = 0.55
    chunk: int = 768
    pivots: int = 16
    judges: int = 16
    tile: int = 512
    tile_tokens: int = 1_000_000
    seed: int = 6

    @property
    def runs(self) -> int:
        """A run keeps a pair at the threshold if it shares a sampled token on every level. It
        shares at least ``width`` x ``threshold`` on the average, by the larger set's size."""
        kept = (1 - math.exp(-self.width * self.threshold)) ** self.levels
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - kept)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(data: bytes, k: int) -> np.ndarray:
    """The set of hashed word k-grams of a UTF-8 text, ascending. A text of fewer words is one
    gram of all of them; one without words is the empty set."""
    words = data.split()
    if not words:
        return np.zeros(0, np.uint64)
    crc = np.fromiter(map(crc32, words), np.uint64, len(words))
    k = min(k, len(crc))
    out = np.full(len(crc) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out + crc[i : len(crc) - k + 1 + i] * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def sampled(tokens: np.ndarray, config: JoinConfig) -> list[np.ndarray]:
    """For each level the tokens chosen by every run, as 64-bit names whose low 8 bits are the
    run. A token is chosen if its hash for run and level is below width / set size."""
    seeds, factors = _seeds(config)
    below = np.uint64(min(int(min(1.0, config.width / max(len(tokens), 1)) * 2.0**64), (1 << 64) - 1))
    found: list[list[np.ndarray]] = [[] for _ in range(config.levels)]
    for at in range(0, len(tokens), 16_384):  # bounded memory for long texts
        part = tokens[at : at + 16_384]
        row, column = np.nonzero(part[None, :] * factors[:, None] <= below)
        names = (_mix(part[column] + seeds[row]) & np.uint64(0xFFFFFFFFFFFFFF00)) | (row % config.runs).astype(np.uint64)
        cuts = np.searchsorted(row, np.arange(1, config.levels) * config.runs)
        for level, chosen in enumerate(np.split(names, cuts)):
            found[level].append(chosen)
    return [np.concatenate([np.zeros(0, np.uint64), *x]) for x in found]


@lru_cache
def _seeds(config: JoinConfig) -> tuple[np.ndarray, np.ndarray]:
    """For every level and run a seed and an odd factor. Tokens are mixed hashes already, so one
    multiplication gives each run its own order of them."""
    seeds = _mix(np.arange(1, config.levels * config.runs + 1, dtype=np.uint64) + np.uint64(config.seed << 32))
    return seeds, _mix(seeds) | np.uint64(1)


def sketch_of(tokens: np.ndarray, size: int) -> np.ndarray:
    """The smallest hashes of a set (32 bits), ascending."""
    h = np.unique((_mix(tokens + np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32))
    return h[:size]


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sets without repeats. Tokens of many sets are
    multiplied as a dense matrix, the others are counted pair by pair."""
    m = len(sets)
    flat = np.concatenate(sets) if m else np.zeros(0)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(flat)))
    total = np.zeros((m, m), np.float32)
    often = np.flatnonzero(size > 12)
    for part in range(0, len(often), 2048):  # bounded width of the matrix
        mine = often[part : part + 2048]
        dense = np.zeros((m, len(mine)), np.float32)
        column = np.repeat(np.arange(len(mine)), size[mine])
        at = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(size[mine])[:-1]]), size[mine]) + np.arange(size[mine].sum())
        dense[owner[at], column] = 1
        total += dense @ dense.T
    for width in range(2, 13):
        mine = starts[size == width]
        if len(mine):
            who = owner[mine[:, None] + np.arange(width)]
            for i in range(width):
                for j in range(i + 1, width):
                    np.add.at(total, (who[:, i], who[:, j]), 1)
                    np.add.at(total, (who[:, j], who[:, i]), 1)
    total[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return total


def first_members(linked: np.ndarray) -> np.ndarray:
    """The lowest member of each node's connected part of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def suspected(sketches: list[np.ndarray], config: JoinConfig) -> np.ndarray:
    """Pairs whose sketches look similar; exact for sets that fit into a sketch."""
    common = common_counts(sketches)
    n = np.array([len(s) for s in sketches])
    union = np.minimum(config.sketch, n[:, None] + n[None, :] - common)
    return common >= config.suspect * np.maximum(union, 1)


def _grouped(keys: list[str], work: Callable[[pd.DataFrame], list[tuple]], columns: list[str]):
    """A function over the batches of a partition sorted by ``keys``, which calls ``work`` with
    the rows of each group; groups may lie across batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            k = batch[keys].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            out: list[tuple] = []
            if held and (held[-1][keys].iloc[-1].to_numpy() != k[0]).any():
                out += work(pd.concat(held))
                held = []
            edges = [0, *cuts.tolist(), len(batch)]
            for a, b in zip(edges[:-2], edges[1:-1]):
                piece = batch.iloc[a:b]
                out += work(pd.concat([*held, piece]) if held else piece)
                held = []
            held.append(batch.iloc[edges[-2] :])
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame(work(pd.concat(held)), columns=columns)

    return run


def _in_groups(df: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``work`` on every group of rows, without a call from Spark for each of many small groups."""
    names = [x.split()[0] for x in schema.split(", ")]
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_grouped(keys, work, names), schema)


def connected(edges: DataFrame) -> DataFrame:
    """``node, first`` for stored edges (a, b) between comparable nodes: the smallest node of the
    connected component. Large-star and small-star rounds; each is written to the shared folder,
    so the lineage stays short. Hubs are reduced in the map tasks, and the minima are stored, so
    that the join back to a hub's edges can be split.
    """

    def star(links: DataFrame, small: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.filter("b <= a") if small else both
        least = stored(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        met = near.join(least, "a")
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")) if small else met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b")) if small else moved.limit(0)
        return moved.unionByName(own).filter("a <> b").distinct()

    links = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        new = stored(star(stored(star(links, False)), True))
        # Done when every node hangs on a root: no node is both a child and a parent, nor twice a child.
        children = new.groupBy("a").count()
        split = children.filter("count > 1").limit(1).count() + new.join(new.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        links = new
        if not split:
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("first")).distinct()
    return stored(links.select(F.col("a").alias("node"), F.col("b").alias("first")).unionByName(roots))


def signatures(docs: DataFrame, config: JoinConfig) -> DataFrame:
    """Per document: ``doc`` (struct of id and th), the digest of its set (k1, k2), its size, its
    sketch and the sampled tokens of each level. Stored; the text is read once."""
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id")
    rows = docs.select(key, F.xxhash64(text_of()).alias("th"), text_of().alias("text"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, th, text in zip(batch["id"], batch["th"], batch["text"]):
                tokens = grams(text.encode("utf-8"), config.words)
                digest = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64)
                levels = [x.astype(np.int64) for x in sampled(tokens, config)] if len(tokens) else [np.zeros(0, np.int64)] * config.levels
                out.append(({"id": i, "th": th}, int(digest[0]), int(digest[1]), len(tokens), sketch_of(tokens, config.sketch).astype("<u4").tobytes(), levels))
            yield pd.DataFrame(out, columns=["doc", "k1", "k2", "size", "sketch", "chosen"])

    return stored(rows.mapInPandas(sign, "doc struct<id: bigint, th: bigint>, k1 long, k2 long, size int, sketch binary, chosen array<array<bigint>>"))


def alike(big: DataFrame, sets: DataFrame, config: JoinConfig) -> DataFrame:
    """The paths of big buckets whose sets mostly share their tokens, so that sampling another one
    would keep most of them together: judged by the sketches of ``judges`` members, the first by
    hash, cut in the map tasks. The verdict is on work alone; a bucket is compared either way."""
    order = W.partitionBy("path").orderBy(F.xxhash64(F.lit(config.seed), "path", "doc"), "doc")
    some = big.select("path", "doc").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.judges)
    judged = some.join(sets.select("doc", "sketch"), "doc").groupBy("path").agg(F.collect_list("sketch").alias("sketches"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for path, listed in zip(batch["path"], batch["sketches"]):
                sketches = [np.frombuffer(x, "<u4") for x in listed]
                n = np.array([len(s) for s in sketches])
                common = common_counts(sketches)
                jaccard = common / np.maximum(np.minimum(config.sketch, n[:, None] + n[None, :] - common), 1)
                shared = 2 * jaccard / (1 + jaccard)  # share of a set's tokens that the other holds
                pairs = len(n) * (len(n) - 1)
                if pairs and (shared.sum() - np.trace(shared)) / pairs > 0.5:
                    kept.append(path)
            yield pd.DataFrame({"path": kept}, dtype="int64")

    return stored(judged.mapInPandas(judge, "path long"))


def buckets(sets: DataFrame, config: JoinConfig) -> DataFrame:
    """``path, doc, n``: the sets of every bucket to be compared, of all runs."""
    leaves = []
    rows = sets.select("doc", F.explode(F.col("chosen")[0]).alias("path"))
    for level in range(config.levels):
        counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rows = stored(rows.join(stored(counts), "path"))
        if level == config.levels - 1:
            leaves.append(rows)
            break
        leaves.append(rows.filter(F.col("n") <= config.limit))
        big = rows.filter(F.col("n") > config.limit)
        if big.isEmpty():
            break
        together = alike(big, sets, config)
        leaves.append(big.join(together, "path", "left_semi"))
        big = big.join(together, "path", "left_anti")
        next_tokens = sets.select("doc", F.col("chosen")[level + 1].alias("next"))
        same_run = F.filter("next", lambda t: t.bitwiseAND(F.lit(255)) == F.col("path").bitwiseAND(F.lit(255)))
        mixed = F.xxhash64(F.col("path"), F.col("token"))
        child = mixed - F.pmod(mixed, F.lit(256)) + F.pmod(F.col("path"), F.lit(256))
        split = stored(
            big.join(next_tokens, "doc").withColumn("token", F.explode(same_run)).select(F.col("path").alias("parent"), child.alias("path"), "doc", "n")
        )
        # A parent whose sets mostly stay together all the same is compared as it is.
        sizes = split.groupBy("parent", "path").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
        dense = stored(
            sizes.groupBy("parent").agg((F.sum(F.col("c") * F.col("c")) / F.sum("c") > F.max("n") * 0.5).alias("dense")).filter("dense").select("parent")
        )
        leaves.append(big.join(dense.withColumnRenamed("parent", "path"), "path", "left_semi"))
        rows = split.join(dense, "parent", "left_anti").select("path", "doc")
    return reduce(DataFrame.unionByName, [x.select("path", "doc", "n") for x in leaves])


def candidates(sets: DataFrame, config: JoinConfig) -> DataFrame:
    """Edges (a, b) that join the sets which look similar in some bucket: of each bucket those
    from the members of a connected part to its first. Stored."""
    leaves = stored(buckets(sets, config))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / config.chunk)).cast("int")
    dealt = leaves.select("path", "doc", chunks.alias("chunks"), F.pmod(F.xxhash64("doc", "path"), chunks).cast("int").alias("chunk"))
    # Every two chunks of a large bucket meet in a task, so that no pair of its sets is left out.
    members = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = members.join(sets.select("doc", "sketch"), "doc")
    rows = rows.select(
        "path", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"),
        F.col("doc.id").alias("id"), F.col("doc.th").alias("th"), "sketch",
    )

    def connect(group: pd.DataFrame) -> list[tuple]:
        if len(group) < 2:
            return []
        ids, ths = group["id"].to_numpy(), group["th"].to_numpy()
        sketches = [np.frombuffer(x, "<u4") for x in group["sketch"]]
        first = first_members(suspected(sketches, config))
        return [(int(ids[i]), int(ths[i]), int(ids[j]), int(ths[j])) for i, j in enumerate(first) if i != j]

    found = _in_groups(rows, ["path", "c1", "c2"], connect, "a_id long, a_th long, b_id long, b_th long").distinct()
    return stored(found.select(F.struct(F.col("a_id").alias("id"), F.col("a_th").alias("th")).alias("a"), F.struct(F.col("b_id").alias("id"), F.col("b_th").alias("th")).alias("b")))


def verified(docs: DataFrame, groups: DataFrame, weights: DataFrame, config: JoinConfig) -> DataFrame:
    """Exact comparison of all pairs inside groups (node, first). ``weights`` (doc, copies) are
    the documents that a set stands for. Returns rows of two kinds: ``doc, links, texts`` (the
    documents and the sets linked, to be summed) and ``doc, other`` (edges that connect what is
    linked). Texts are read again for members of groups only; each goes to the tiles of its group.
    """
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_of()).alias("th"))
    sized = groups.join(weights, groups["node"] == weights["doc"]).select("doc", "first", "copies", "size")
    per_group = sized.groupBy("first").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("tokens"))
    tiles = F.greatest(F.ceil(F.col("members") / config.tile), F.ceil(F.col("tokens") / config.tile_tokens)).cast("int")
    placed = sized.join(per_group.select("first", tiles.alias("tiles")), "first")
    placed = stored(placed.withColumn("tile", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int")))
    # A merge join at every size: what is placed grows with the corpus.
    texts = docs.select(key.alias("doc"), text_of().alias("text")).join(placed.hint("merge"), "doc")
    if not docs.select(key.alias("doc")).join(placed.select("doc"), "doc").groupBy("doc").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["doc"])
    texts = texts.select(F.col("doc.id").alias("id"), F.col("doc.th").alias("th"), F.col("first.id").alias("g"), F.col("first.th").alias("gt"), "tile", "tiles", "copies", "text")

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(tokens=[grams(t.encode("utf-8"), config.words).astype("<u8").tobytes() for t in batch["text"]]).drop(columns="text")

    sets = texts.mapInPandas(tokens, "id long, th long, g long, gt long, tile int, tiles int, copies long, tokens binary")
    both = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = both.select("g", "gt", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "id", "th", "copies", "tokens")
    threshold = config.threshold

    def compare(group: pd.DataFrame) -> list[tuple]:
        tile, copies = group["tile"].to_numpy(), group["copies"].to_numpy(float)
        ids, ths = group["id"].to_numpy(), group["th"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in group["tokens"]]
        n = np.array([len(s) for s in sets])
        common = common_counts(sets)
        linked = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-6
        np.fill_diagonal(linked, False)
        if group["t1"].iloc[0] != group["t2"].iloc[0]:
            linked &= tile[:, None] != tile[None, :]  # pairs inside a tile have a group of their own
        links, texts = linked @ copies, linked.sum(1)
        first = first_members(linked)
        return [
            (int(ids[i]), int(ths[i]), int(links[i]), int(texts[i]), int(ids[first[i]]), int(ths[first[i]]))
            for i in range(len(ids)) if texts[i]
        ]

    return stored(_in_groups(rows, ["g", "gt", "t1", "t2"], compare, "id long, th long, links long, texts long, b_id long, b_th long"))


def join_classes(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """A row per document: ``doc_id, th`` (hash of its text), ``class_id`` and ``class_th`` (the
    first document that it is connected with by links, possibly itself), ``n_links`` (other
    documents at the threshold or above), ``n_copies`` (documents with the same set, itself
    included) and ``n_linked_texts`` (other sets linked).

    Texts without words are copies of each other, a null one included. Texts of fewer than
    ``words`` words are linked to equal ones only. Rows alike in id and text count as copies. A
    null id comes last. An empty table gives an empty one.
    """
    signed = signatures(docs, config)
    reps = stored(
        signed.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"))
    )
    own = signed.select("doc", "sketch", "chosen").filter(F.size(F.col("chosen")[0]) > 0)
    sets = stored(one_per_key(own.join(reps.select("doc"), "doc"), ["doc"]))
    edges = candidates(sets, config)
    groups = connected(edges)
    found = verified(docs, groups, reps.select("doc", "copies", "size"), config)
    doc, other = F.struct("id", "th"), F.struct(F.col("b_id").alias("id"), F.col("b_th").alias("th"))
    classes = connected(found.select(doc.alias("a"), other.alias("b")))
    sums = found.groupBy(doc.alias("doc")).agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    per_set = (
        reps.join(sums, "doc", "left")
        .join(classes.withColumnRenamed("node", "doc"), "doc", "left")
        .select("k1", "k2", F.coalesce("first", "doc").alias("first"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"))
    )
    every = signed.select("doc", "k1", "k2").join(per_set, ["k1", "k2"])
    no_null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return every.select(
        no_null("doc.id").alias("doc_id"), F.col("doc.th").alias("th"), no_null("first.id").alias("class_id"), F.col("first.th").alias("class_th"),
        (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), F.col("texts").alias("n_linked_texts"),
    )


def keep_first(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """The documents that are the first of their class, one row each."""
    found = join_classes(docs, config)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th")))
    first = first.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("th").alias("__th")).distinct()
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id"), F.lit(NO_ID)), "__th": F.xxhash64(text_of())})
    narrow = keyed.groupBy("__id", "__th").count().filter("count > 1")
    kept = keyed.join(first, ["__id", "__th"], "left_semi")
    return (kept if narrow.isEmpty() else kept.dropDuplicates(["__id", "__th"])).select(*docs.columns)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark, 8)
    return join_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_copies", "n_linked_texts")


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLES: dict[str, str] = {}
