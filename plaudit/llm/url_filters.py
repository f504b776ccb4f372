"""URL filters: ordered host and path rules, and exact list membership by a Bloom filter cascade.

Everything is a column expression. A cascade is one row with an array of filters; a lookup reads
it as a scalar subquery, so the pages meet no join and no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import stored, table

#: Fixed values of the task: (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words that put a host on the list when one of its dash or dot separated parts is among them.
LISTED_WORDS = (
    "ad ads adult adults adserver banner bet bets betting casino casinos cheap click doubleclick farm "
    "gambling loan loans pharma pills poker popup porn sex slots spam telemetry tracker tracking track "
    "viagra win xxx"
).split()


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (host and path together) that fits, as a struct (rule, verdict), or null.

    A rule fits its host and all subdomains when the path starts with the rule's. Of equally
    long rules the longer host wins, then block.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    chosen = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in ranked
    ]
    return F.coalesce(*chosen)


def listed_host(host: Column, words: Sequence[str] = tuple(LISTED_WORDS)) -> Column:
    """Whether a part of the host name is one of the words."""
    return F.arrays_overlap(F.split(host, r"[.\-_]"), F.array(*[F.lit(w) for w in words]))


@dataclass(frozen=True)
class CascadeConfig:
    """``first_rate``: false positives of level 0; ``rate``: of the levels below it.

    All filters together may take ``max_bits`` (32 MB); a longer list is joined instead.
    """

    first_rate: float = 0.05
    rate: float = 0.5
    max_bits: int = 1 << 28


@dataclass(frozen=True)
class Level:
    """One filter: a single-row table with the array ``words`` of 64-bit words."""

    number: int
    words: DataFrame
    n_bits: int
    hashes: int


@dataclass(frozen=True)
class Cascade:
    """``levels`` from the first on; ``keys``, the listed ones, serve lists beyond the bound."""

    levels: tuple[Level, ...]
    keys: DataFrame
    fits: bool


def _shape(keys: int, rate: float) -> tuple[int, int]:
    """Bits (whole words) and hash functions for a number of keys and a false positive rate."""
    bits = max(64, math.ceil(keys * -math.log(rate) / math.log(2) ** 2))
    return bits + (-bits) % 64, max(1, round(-math.log2(rate)))


def _positions(key: Column, level: int, n_bits: int, hashes: int) -> list[Column]:
    """Bit positions of a key: double hashing with a seed of the level."""
    start = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(n_bits))
    step = F.pmod(F.xxhash64(F.lit("step"), key, F.lit(level)), F.lit(n_bits - 1)) + 1
    return [F.pmod(start + step * i, F.lit(n_bits)) for i in range(hashes)]


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))


def _filter_of(keys: DataFrame, number: int, count: int, rate: float) -> Level:
    """Bits are or-ed in the map tasks; the words of the filter, ``n_bits / 64``, meet in one row."""
    n_bits, hashes = _shape(count, rate)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, n_bits, hashes))).alias("at"))
    set_bits = at.select((F.col("at") / 64).cast("bigint").alias("word"), _bit(F.col("at")).alias("bit"))
    all_words = keys.sparkSession.range(n_bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bit"))
    words = set_bits.unionAll(all_words).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    row = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.col("w.bits").alias("words"))
    return Level(number, stored(row), n_bits, hashes)


def _in_filter(key: Column, level: Level) -> Column:
    words = level.words.scalar()
    hits = [
        F.element_at(words, ((at / 64).cast("bigint") + 1).cast("int")).bitwiseAND(_bit(at)) != 0
        for at in _positions(key, level.number, level.n_bits, level.hashes)
    ]
    return F.array_min(F.array(*hits))


def build_cascade(universe: DataFrame, config: CascadeConfig = CascadeConfig()) -> Cascade:
    """A cascade for ``universe`` (key, listed): every key that lookups will meet, with whether
    it is on the list. Null keys are ignored, repeated ones count once; a key that appears both
    as listed and unlisted is listed.

    Level 0 holds the listed keys, level 1 the unlisted keys that level 0 takes for listed,
    level 2 the listed keys that level 1 takes for those, and so on until none is mistaken.
    """
    known = stored(
        universe.filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.max(F.coalesce(F.col("listed"), F.lit(False))).alias("listed"))
    )
    listed, others = known.filter("listed").select("key"), known.filter("not listed").select("key")
    count = listed.count()
    fits = _shape(count, config.first_rate)[0] <= config.max_bits // 2
    levels: list[Level] = []
    inside, outside = listed, others
    while count and fits:
        level = _filter_of(inside, len(levels), count, config.rate if levels else config.first_rate)
        levels.append(level)
        mistaken = stored(outside.filter(_in_filter(F.col("key"), level)))
        inside, outside, count = mistaken, inside, mistaken.count()
        fits = sum(x.n_bits for x in levels) <= config.max_bits
    return Cascade(tuple(levels), listed, fits)


def with_listed(df: DataFrame, key: str, cascade: Cascade, name: str = "listed") -> DataFrame:
    """Adds whether ``key`` is listed, exact for every key of the cascade's universe; a null key
    is not. The first filter without the key decides: it is listed if that level is an odd one.
    """
    if not cascade.fits:
        keys = cascade.keys.select(F.col("key").alias("__listed_key"))
        joined = df.join(keys, F.col(key) == F.col("__listed_key"), "left")
        return joined.withColumn(name, F.col("__listed_key").isNotNull()).drop("__listed_key")
    answer = F.lit(len(cascade.levels) % 2 == 1)
    for level in reversed(cascade.levels):
        answer = F.when(_in_filter(F.col(key), level), answer).otherwise(F.lit(level.number % 2 == 1))
    return df.withColumn(name, F.when(F.col(key).isNull(), F.lit(False)).otherwise(answer))


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    words: Sequence[str] = tuple(LISTED_WORDS),
    config: CascadeConfig = CascadeConfig(),
) -> DataFrame:
    """Adds host, path, rule, listed and verdict to ``pages``.

    The universe are all hosts of the table; on the list are those with one of ``words`` as a
    part of their name. A rule that fits decides; without one, a listed host is blocked. A null
    url or one without ``://`` has an empty host and path, and is allowed. Columns of these
    names that the table has already are replaced. An empty table gives an empty one.
    """
    named = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    hosts = named.select(F.col("host").alias("key")).distinct()
    cascade = build_cascade(hosts.select("key", listed_host(F.col("key"), words).alias("listed")), config)
    found = matching_rule(F.col("host"), F.col("path"), rules)
    known = with_listed(named, "host", cascade)
    verdict = F.coalesce(found["verdict"], F.when(F.col("listed"), "block").otherwise("allow"))
    return known.withColumns({"rule": found["rule"], "verdict": verdict})


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "listed")


def _oracle() -> str:
    rest = "substr(coalesce(url, ''), strpos(coalesce(url, ''), '://') + 3)"
    ranked = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in ranked]
    rule = " ".join(f"WHEN {f} THEN '{h + p}'" for f, (_, h, p) in zip(fits, ranked))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ranked))
    words = ", ".join(f"'{w}'" for w in LISTED_WORDS)
    return f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN {rest} ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), named AS (
            SELECT page_id, path,
                   translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts
        ), known AS (
            SELECT *, list_has_any(regexp_split_to_array(host, '[-._]'), [{words}]) AS listed FROM named
        )
        SELECT page_id, host, path, listed, CASE {rule} END AS rule,
               CASE {verdict} WHEN listed THEN 'block' ELSE 'allow' END AS verdict
        FROM known"""


QUERIES = {"op10_url_filters": op10_url_filters}
ORACLES = {"op10_url_filters": _oracle()}
