"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Every paragraph is hashed to a wide vector, and the vectors are added modulo powers of two. The
order of paragraphs does not matter, and a paragraph is inserted or deleted by adding or
subtracting its vector. The vector has two halves:

* 8 lanes from the SHA-256 of the paragraph, modulo 2^32. They tell texts apart.
* 128 lanes with the signs (1 or -1) of the hashes of its clauses, modulo 2^16. Paragraphs that
  share clauses have similar vectors, and the squared distance of two sums estimates the number
  of clauses that they do not share.

All of it is column expressions, evaluated row by row; texts of any length need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit.llm.common import once, stored, table, text_of

EXACT_LANES = 8
SIGN_LANES = 128
EXACT_MOD, SIGN_MOD = 1 << 32, 1 << 16
#: A clause ends with its line, or behind one of these marks and a blank.
CLAUSE_END = r"\n|(?<=[.!?;,|])[ \t]+"
#: Key of documents without an id, which come last.
NO_ID = (1 << 63) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _wrapped(sign_sum: Column) -> Column:
    """Modulo 2^16, as a signed number."""
    return (F.pmod(sign_sum + SIGN_MOD // 2, F.lit(SIGN_MOD)) - SIGN_MOD // 2).cast("int")


def _exact(paragraphs: Column) -> Column:
    def lanes(p: Column) -> Column:
        return _let(F.sha2(p, 256), lambda d: F.array(*[F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(EXACT_LANES)]))

    zero = F.array_repeat(F.lit(0).cast("bigint"), EXACT_LANES)
    total = F.aggregate(paragraphs, zero, lambda a, p: F.zip_with(a, lanes(p), lambda x, y: x + y))
    return F.transform(total, lambda x: F.pmod(x, F.lit(EXACT_MOD)))


def _signs(clauses: Column) -> Column:
    """Two lanes (bits j and j + 32 of a hash) are summed in one number; their counts stay below
    2^31, as a text does. The sum of signs is twice the count of ones minus the number of clauses."""
    mask = F.lit((1 << 32) + 1).cast("bigint")

    def ones(hashes: Column, j: int) -> Column:
        bits = lambda x: F.call_function("shiftrightunsigned", x, F.lit(j)).bitwiseAND(mask)
        return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, x: a + bits(x))

    def half(seed: int) -> Column:
        hashes = F.transform(clauses, lambda c: F.xxhash64(c, F.lit(seed)))
        return _let(hashes, lambda h: F.array(*[ones(h, j) for j in range(32)]))

    packed = F.concat(half(1), half(2))
    low = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1).cast("bigint"))
    both = F.flatten(F.transform(packed, lambda x: F.array(low(x), F.shiftrightunsigned(x, 32))))
    return F.transform(both, lambda x: _wrapped(2 * x - F.size(clauses)).cast("smallint"))


def vector(text: Column) -> Column:
    """The fingerprint as a struct of ``exact`` (8 lanes) and ``signs`` (128 lanes). Paragraphs
    are the lines of the text, empty ones included; a null text is an empty one."""
    t = F.coalesce(text, F.lit(""))
    clauses = F.filter(F.split(t, CLAUSE_END), lambda c: c != "")
    return F.struct(_exact(F.split(t, "\n")).alias("exact"), _let(clauses, _signs).alias("signs"))


def inserted(total: Column, paragraph: Column) -> Column:
    """The vector of a text after a paragraph (or another text as a line below) is added."""
    return _combined(total, vector(paragraph), 1)


def deleted(total: Column, paragraph: Column) -> Column:
    """The vector of a text after one of its paragraphs is taken out."""
    return _combined(total, vector(paragraph), -1)


def _combined(a: Column, b: Column, sign: int) -> Column:
    return F.struct(
        F.zip_with(a["exact"], b["exact"], lambda x, y: F.pmod(x + sign * y, F.lit(EXACT_MOD))).alias("exact"),
        F.zip_with(a["signs"], b["signs"], lambda x, y: _wrapped(x.cast("int") + sign * y).cast("smallint")).alias("signs"),
    )


def encoded(v: Column) -> Column:
    """A vector as text: base64 of its lanes, 4 and 2 bytes each, highest byte first."""
    digits = lambda x, n: F.lpad(F.hex(x), n, "0")
    exact = F.array_join(F.transform(v["exact"], lambda x: digits(x, 8)), "")
    signs = F.array_join(F.transform(v["signs"], lambda x: digits(F.pmod(x.cast("bigint"), F.lit(SIGN_MOD)), 4)), "")
    return F.translate(F.base64(F.unhex(F.concat(exact, signs))), "\r\n", "")


def likeness(a: Column, b: Column) -> Column:
    """Estimate of 2 |A and B| / (|A| + |B|) over the clauses of two texts, from their vectors:
    1 for equal texts, about 0 for texts without a common clause."""
    square = lambda total, x: total + x.cast("double") * x
    norm = lambda v: F.aggregate(v["signs"], F.lit(0.0), square)
    apart = F.zip_with(a["signs"], b["signs"], lambda x, y: _wrapped(x.cast("int") - y))
    both = norm(a) + norm(b)
    close = F.when(both > 0, 1 - F.aggregate(apart, F.lit(0.0), square) / both).otherwise(0.0)
    return F.when(a["exact"] == b["exact"], 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), close)))


def next_document(ids: DataFrame) -> DataFrame:
    """``id, th, half, next_id, next_th`` for stored rows (id, th, half): the successor in order of
    id and text hash; after the last comes the first.

    The rows are dealt by range and frozen; each range looks ahead inside itself, and its last
    row continues in the next range (a table with one row per range).
    """
    ordered = stored(ids.repartitionByRange("id", "th").withColumn("part", F.spark_partition_id()))
    inside = W.partitionBy("part").orderBy("id", "th")
    ahead = ordered.withColumn("next", F.lead(F.struct("id", "th")).over(inside))
    firsts = stored(ordered.groupBy("part").agg(F.min(F.struct("id", "th")).alias("first")))
    start = firsts.agg(F.min("first")).scalar()
    follow = firsts.withColumn("follow", F.coalesce(F.lead("first").over(W.orderBy("part")), start)).drop("first")
    met = ahead.join(F.broadcast(follow), "part")  # as many rows as ranges
    return met.select("id", "th", "half", F.coalesce("next", "follow").alias("next")).select(
        "id", "th", "half", F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half (the last
    floor(n / 2) code points) is replaced by the beginning of the next document.

    Rows alike in id and text have the same successor. Documents without id come last. The text
    moves once, by the document's key (both joins read the same exchange, so they take the same
    columns), and the beginnings once, to the document before. A lone
    document follows itself; an empty table gives an empty one.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id")
    texts = docs.select(key, F.xxhash64(text_of()).alias("th"), text_of().alias("text"))
    sizes = stored(texts.select("id", "th", (F.length("text") / 2).cast("int").alias("half")))
    unique = sizes.groupBy("id", "th").agg(F.max("half").alias("half"))
    edges = stored(next_document(unique))

    by_next = edges.select(F.col("id").alias("to_id"), F.col("th").alias("to_th"), F.col("half").alias("need"), "next_id", "next_th")
    begins = texts.join(by_next, (F.col("id") == F.col("next_id")) & (F.col("th") == F.col("next_th")), "left")
    begins = begins.select("to_id", "to_th", "next_id", "next_th", F.left("text", F.col("need")).alias("begin"))
    if unique.count() < sizes.count():
        begins = begins.dropDuplicates(["to_id", "to_th"])  # rows alike are one successor
    met = texts.join(begins, (F.col("id") == F.col("to_id")) & (F.col("th") == F.col("to_th")), "left")
    n = F.length("text")
    edited = F.concat(F.left("text", n - (n / 2).cast("int")), F.coalesce("begin", F.lit("")))
    rows = once(met.select("id", "th", "next_id", "next_th", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited")), "v", vector(F.col("text")))
    rows = once(rows.drop("text"), "e", vector(F.col("edited")))
    made = stored(rows.select("id", "th", "next_id", "next_th", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "v", "e"))

    ahead = made.select(F.col("id").alias("a_id"), F.col("th").alias("a_th"), F.col("v").alias("next_v"))
    if unique.count() < sizes.count():
        ahead = ahead.dropDuplicates(["a_id", "a_th"])
    full = made.join(ahead, (F.col("next_id") == F.col("a_id")) & (F.col("next_th") == F.col("a_th")), "left")
    doc_id = F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")
    return full.select(doc_id, "n_chars", "edited_sha256", "v", "e", "next_v")


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    made = fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256",
        encoded(F.col("v")).alias("fingerprint"), encoded(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("e")).alias("near_edited"), likeness(F.col("v"), F.col("next_v")).alias("near_next"),
    )


QUERIES = {"op5_fingerprints": op5_fingerprints}
ORACLES: dict[str, str] = {}
