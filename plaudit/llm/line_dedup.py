"""Line dedup: later repeats of passages are found by winnowing over line hashes and deleted.

Texts are folded into lines of one word each, so a passage is folded alike wherever it stands, also
in the middle of a long line and without any marks. Of the hashes of ``gram`` lines in a row the
minimum of every window is a fingerprint: any shared run of ``window + gram - 1`` words has a common
one. The first occurrence of each fingerprint, in document order, is the partner of all later ones.
A gram has as many words as a run must have, so whatever else the first place holds, the gram itself
is a run to delete from the later text; the match is extended both ways word by word. Fingerprints
inside a shared run are at most ``window`` apart, so their grams cover it but for fewer than
``window`` words at either end, which stay if the first places of the outermost grams do not share
them. What is deleted always stands in an earlier place, and the first place stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import bounded_batches, map_columns, one_per_key, stored, table, text_of
from plaudit.operators.scale import hash_bitmap, sift

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Key of documents without an id, which come last.
NO_ID = (1 << 63) - 1
#: Bits (log2) of the bitmaps of repeated fingerprints and of documents with hits.
MARK_BITS = 25
DOC_BITS = 23


@dataclass(frozen=True)
class DedupConfig:
    """Runs of fewer than ``min_words`` words stay. Any run of ``gram + window - 1`` shared words
    has a common fingerprint, which must not exceed 51. ``gram`` is not below ``min_words``: each
    common gram is a run by itself."""

    min_words: int = 40
    gram: int = 40
    window: int = 12

    def __post_init__(self):
        if self.gram < self.min_words:
            raise ValueError("gram must not be below min_words")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold_all(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lines of UTF-8 texts, one text behind the other: the hashes of their words (32 bits), and
    where each text begins among them (one entry more than texts)."""
    words: list[bytes] = []
    begin = [0]
    for data in texts:
        words += data.split()
        begin.append(len(words))
    return np.fromiter(map(crc32, words), np.uint32, len(words)), np.array(begin, np.int64)


def _grams(lines: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` lines in a row from each line on, put together from those of powers of
    two. The last ``size - 1`` run over the end and mean nothing."""
    step = np.uint64(0x9E3779B97F4A7C15)
    part, width, out, done = _mix(lines.astype(np.uint64) + step), 1, None, 0

    def joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        ahead = np.zeros_like(b)
        ahead[: max(len(b) - shift, 0)] = b[shift:]
        return _mix(a * step + ahead)

    while True:
        if size & width:
            out = part if out is None else joined(out, part, done)
            done += width
        if done == size:
            return out
        part, width = joined(part, part, width), 2 * width


def winnow_all(lines: np.ndarray, begin: np.ndarray, config: DedupConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of texts that stand one behind the other, the number of the text and the line
    where each begins: the minimum of every window, the leftmost of equal ones. A text shorter
    than a window, or than a gram, has one, over what it has."""
    if not len(lines):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    n = np.diff(begin)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(lines)) - begin[:-1][owner]
    grams = _grams(lines, config.gram)
    short = np.flatnonzero((n > 0) & (n < config.gram))
    for i in short:
        grams[begin[i]] = _grams(lines[begin[i] : begin[i + 1]], int(n[i]))[0]
    # A gram that runs over the end of its text counts only if the text has no whole one.
    whole = at <= np.maximum(n[owner] - config.gram, 0)
    grams, owner, at = grams[whole], owner[whole], at[whole]
    left = np.bincount(owner, minlength=len(n))[owner] - at  # grams from here to the end of the text
    place = np.arange(len(grams))
    best, width = place.copy(), 1
    while width < config.window:  # the leftmost minimum of twice as many grams, or of all of the window
        shift = min(width, config.window - width)
        other = best[np.minimum(place + shift, len(grams) - 1)]
        best = np.where((left > shift) & (grams[other] < grams[best]), other, best)
        width += shift
    first = (left >= config.window) | (at == 0)
    chosen = np.unique(best[first])
    return grams[chosen].astype(np.int64), owner[chosen], at[chosen].astype(np.int32)


def _parts(values: np.ndarray, begin: np.ndarray, kind: str) -> list[bytes]:
    """The values of each text as bytes."""
    values, edges = values.astype(kind), begin.tolist()
    return [values[a:b].tobytes() for a, b in zip(edges, edges[1:])]


def winnowed(lines: np.ndarray, config: DedupConfig) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of one text and the lines where they begin."""
    marks, _, at = winnow_all(lines, np.array([0, len(lines)]), config)
    return marks, at


def repeated_runs(
    later: np.ndarray, earlier: np.ndarray, hits: list[tuple[int, int]], config: DedupConfig, shift: int | None = None
) -> list[tuple[int, int]]:
    """Runs of lines of the later text, from hits (line there, line in the earlier text) extended
    both ways by less than a window, since behind that the next hit lies; those that meet are
    joined. The work grows with the hits, however a text repeats itself. ``shift`` is given where
    both are one text: line i of the earlier is line i + shift of the later, and a run begins no
    earlier than behind the gram that it repeats."""
    found, edge = [], config.window - 1
    around = np.arange(-edge, config.gram + edge)
    for part in range(0, len(hits), 16_384):  # bounded memory
        b, a = np.array(hits[part : part + 16_384], np.int64).T
        mine, other = b[:, None] + around, a[:, None] + around
        inside = (mine >= 0) & (mine < len(later)) & (other >= 0) & (other < len(earlier))
        same = inside & (later[np.where(inside, mine, 0)] == earlier[np.where(inside, other, 0)])
        before = np.logical_and.accumulate(same[:, edge - 1 :: -1][:, :edge], axis=1).sum(1) if edge else 0
        behind = np.logical_and.accumulate(same[:, edge + config.gram :], axis=1).sum(1)
        whole = same[:, edge : edge + config.gram].all(1)  # else equal fingerprints of different lines
        first, last = b - before, b + config.gram + behind
        if shift is not None:
            first = np.maximum(first, a + shift + config.gram)
        whole &= first < last
        found += zip(first[whole].tolist(), last[whole].tolist())
    merged: list[tuple[int, int]] = []
    for first, last in sorted(found):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


def without_runs(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without runs of its words, and the number of words taken out. The blanks
    behind a deleted run go with it, at the end of the text those before it."""
    data = text.encode("utf-8")
    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    kept, at, removed, covered = [], 0, 0, 0
    for a, b in sorted(runs):
        a = max(a, covered)
        if a >= b:
            continue
        covered = b
        kept.append(data[at : starts[a]])
        at = starts[b]
        removed += b - a
    rest = data[at:]
    out = b"".join(kept) + rest
    return (out if rest else out.rstrip(b" \t\n\x0b\x0c\r")).decode("utf-8"), removed


def repeats(docs: DataFrame, config: DedupConfig = DedupConfig()) -> DataFrame:
    """``id, th, runs``: the runs of lines to delete from each document that has any. The id is
    the doc_id (a null one comes last), th tells documents with one id apart.

    The corpus is read once; its line hashes, 4 bytes a word, and its fingerprints, 12 bytes for
    every six or seven words, are stored. Fingerprints that occur
    once go after a count; a hot one meets its first place by a join whose large side is split
    (counts and first places are stored, so both sides of the joins are plain exchanges). Later
    and earlier texts are joined from one exchange of the line hashes. Bitmaps of constant size
    keep out of the exchanges what has no partner; on a corpus with more partners than they have
    bits they keep out less, and the joins find the same.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id")
    rows = docs.filter(F.col("text").isNotNull()).select(key, F.xxhash64(text_of()).alias("th"), "text")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, begin = fold_all([t.encode("utf-8") for t in batch["text"]])
            sizes = np.diff(begin)
            enough = sizes >= config.min_words
            ends = np.concatenate([[0], np.cumsum(sizes[enough])])
            marks, owner, at = winnow_all(hashes[np.repeat(enough, sizes)], ends, config)
            each = np.zeros(len(sizes), np.int64)  # fingerprints of each text
            each[enough] = np.bincount(owner, minlength=len(ends) - 1)
            upto = np.concatenate([[0], np.cumsum(each)])
            yield pd.DataFrame({
                "id": batch["id"], "th": batch["th"], "folds": _parts(hashes, begin, "<u4"),
                "marks": _parts(marks, upto, "<i8"), "places": _parts(at, upto, "<i4"),
            })

    packed = "id long, th long, folds binary, marks binary, places binary"
    lines = one_per_key(stored(rows.mapInPandas(fold, packed)), ["id", "th"])
    marked = lines.filter(F.octet_length("marks") > 0)

    def only_marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"h": np.frombuffer(b"".join(batch["marks"]), "<i8")})

    def held_marks(held):
        """The fingerprints that the bitmap may hold."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                marks = np.frombuffer(b"".join(batch["marks"]), "<i8")
                place = marks & ((1 << MARK_BITS) - 1)
                likely = np.flatnonzero((held.value[place >> 6] >> (place & 63)) & 1)
                owner = np.repeat(np.arange(len(batch)), [len(x) // 8 for x in batch["marks"]])[likely]
                at = np.frombuffer(b"".join(batch["places"]), "<i4")[likely]
                yield pd.DataFrame({"h": marks[likely], "id": batch["id"].to_numpy()[owner], "th": batch["th"].to_numpy()[owner], "pos": at})

        return marked.select("id", "th", "marks", "places").mapInPandas(run, "h long, id long, th long, pos int")

    counted = marked.select("marks").mapInPandas(only_marks, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    several = stored(counted.filter("n > 1").select("h"))
    # Most fingerprints occur once: a bitmap of constant size drops them where they are made.
    found = hash_bitmap(several, F.col("h"), MARK_BITS).toArrow()
    bits = np.zeros(1 << (MARK_BITS - 6), np.int64)
    bits[found.column("word").to_numpy()] = found.column("set_bits").to_numpy()
    likely = held_marks(docs.sparkSession.sparkContext.broadcast(bits))
    shared = stored(likely.join(several, "h"))
    firsts = stored(shared.groupBy("h").agg(F.min(F.struct("id", "th", "pos")).alias("first")))
    later = shared.join(firsts, "h").filter(F.struct("id", "th", "pos") > F.col("first"))
    hits = stored(later.groupBy("id", "th", F.col("first.id").alias("a_id"), F.col("first.th").alias("a_th")).agg(
        F.collect_list(F.struct("pos", F.col("first.pos").alias("a_pos"))).alias("hits")
    ))
    # Only documents with hits, on either side, are exchanged; both sides take the same columns.
    ids = hits.select("id", "th").union(hits.select("a_id", "a_th"))
    known = stored(hash_bitmap(ids, F.xxhash64("id", "th"), DOC_BITS))
    texts = sift(lines.select("id", "th", "folds"), F.xxhash64("id", "th"), known, DOC_BITS)

    def side(name: str) -> DataFrame:
        return texts.select(*[F.col(c).alias(f"{name}_{c}") for c in ("id", "th", "folds")])

    def around(pos: str, folds: str, start: str, part: str, df: DataFrame) -> DataFrame:
        """Only the part of a text around its hits goes on."""
        least = F.greatest(F.lit(0), F.array_min(pos) - config.window)
        size = F.array_max(pos) + config.gram + config.window - F.col(start)
        return df.withColumn(start, least).withColumn(part, F.substring(folds, 4 * F.col(start) + 1, 4 * size)).drop(folds)

    mine = hits.join(side("late"), (F.col("id") == F.col("late_id")) & (F.col("th") == F.col("late_th")))
    mine = around("hits.pos", "late_folds", "start", "folds_here", mine)
    pairs = mine.join(side("first"), (F.col("a_id") == F.col("first_id")) & (F.col("a_th") == F.col("first_th")))
    pairs = around("hits.a_pos", "first_folds", "a_start", "a_folds", pairs)

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                hits = [(h["pos"] - r.start, h["a_pos"] - r.a_start) for h in r.hits]
                shift = r.a_start - r.start if (r.id, r.th) == (r.a_id, r.a_th) else None
                found = repeated_runs(np.frombuffer(r.folds_here, "<u4"), np.frombuffer(r.a_folds, "<u4"), hits, config, shift)
                out += [(r.id, r.th, r.start + a, r.start + b) for a, b in found]
            yield pd.DataFrame(out, columns=["id", "th", "first", "last"])

    named = pairs.select("id", "th", "a_id", "a_th", "hits", "start", "a_start", "folds_here", "a_folds")
    runs = named.mapInPandas(extend, "id long, th long, first int, last int")
    return runs.groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def dedup_lines(docs: DataFrame, config: DedupConfig = DedupConfig(), into: str = "removed_words") -> DataFrame:
    """The documents without the passages that an earlier place holds, and the number of words
    taken out, as ``into``.

    Documents are ordered by id. A copy of a whole text is a repeat as well: if it has
    ``min_words`` words, its text becomes empty. Rows alike in id and text are one document and
    get the same result. A null text stays null. All columns stay; ``n_chars``, if there, is
    counted anew, and a column ``into`` is replaced. An empty table gives an empty one.
    """
    docs = docs.drop(into)
    found = stored(repeats(docs, config).withColumnsRenamed({"id": "__id", "th": "__th", "runs": "__runs"}))
    own_id, own_th = F.coalesce(F.col("doc_id"), F.lit(NO_ID)), F.xxhash64(text_of())
    # Texts without runs, as the bitmap of the others says, do not move.
    known, key = stored(hash_bitmap(found, F.xxhash64("__id", "__th"), DOC_BITS)), F.xxhash64(own_id, own_th)
    some, rest = sift(docs, key, known, DOC_BITS), sift(docs, key, known, DOC_BITS, invert=True)
    met = some.join(found, (own_id == F.col("__id")) & (own_th == F.col("__th")), "left").select(*[some[c] for c in docs.columns], "__runs")
    met = met.union(rest.withColumn("__runs", F.lit(None).cast(found.schema["__runs"].dataType)))
    sized = "n_chars" in docs.columns

    def cut(batch: pa.RecordBatch) -> tuple[None, dict[str, list]]:
        texts, removed = batch.column("text").to_pylist(), np.zeros(batch.num_rows, np.int64)
        sizes = batch.column("n_chars").to_pylist() if sized else []
        for i, runs in enumerate(batch.column("__runs").to_pylist()):
            if runs:
                texts[i], removed[i] = without_runs(texts[i], [(r["first"], r["last"]) for r in runs])
                if sized:
                    sizes[i] = len(texts[i])
        return None, {"text": texts, into: removed} | ({"n_chars": sizes} if sized else {})

    new = {"text": "string", into: "long"} | ({"n_chars": docs.schema["n_chars"].dataType.simpleString()} if sized else {})
    return map_columns(met, cut, new, drop=("__runs",))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark, 8)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "removed_words")


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES: dict[str, str] = {}
