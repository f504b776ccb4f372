"""Text expressions: cleaning, normal forms, clauses, tokens."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaudit import config as C


def clean_text(text: Column) -> Column:
    """URLs to a space, control characters dropped, white space collapsed, ends trimmed.

    ``(?U)`` makes ``\\s`` follow Unicode; the four separators after U+001B count as white
    space too when they end a URL. Collapsing first leaves only plain spaces for ``trim``, and
    covers the ideographic space. A plain space by itself, by far the most frequent case, is no match.
    """
    url = C.URL_PATTERN.replace(r"\S", r"[^\s\x1c-\x1f]")
    out = F.regexp_replace(text, "(?U)" + url, " ")
    out = F.regexp_replace(out, C.CONTROL_PATTERN, "")
    return F.trim(F.regexp_replace(out, r"(?U)[\s&&[^ ]]\s*+| \s++", " "))


def normalize_text(text: Column) -> Column:
    """Only CJK ideographs, ASCII letters and digits survive. Taking out their runs costs a fraction
    of replacing everything between them, and runs are fewer without the spaces."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    return F.array_join(F.regexp_extract_all(bare, F.lit(C.WORD_PATTERN + "+"), F.lit(0)), "")


def template_head(norm: Column, chars: int) -> Column:
    """Opening of a normalised text after runs of one character shrink to one; NULL if the
    text has fewer than ``chars`` characters. A run leaves one or two characters, so the first
    ``chars`` runs hold the opening."""
    runs = F.regexp_extract(norm, rf"(?s)^(?:(.)\1*+){{1,{chars}}}+", 0)
    squeezed = F.regexp_replace(runs, C.REPEAT_PATTERN, "$1")
    return F.when(F.length(norm) >= chars, F.substring(squeezed, 1, chars))


def text_digest(text: Column) -> Column:
    """256-bit digest that stands for the text as a grouping key, so that shuffles carry
    32 bytes and not the text."""
    return F.unhex(F.sha2(text, 256))


def is_advert(text: Column, pattern: str = C.AD_PATTERN) -> Column:
    first = f"(?=[{C.AD_FIRST}])" if pattern == C.AD_PATTERN else ""
    return text.rlike(f"{first}(?iU)(?:{pattern})")


def clauses(text: Column, pattern: str, min_chars: int) -> Column:
    parts = F.transform(F.split(text, pattern), lambda c: F.trim(c))
    return F.filter(parts, lambda c: F.length(c) >= min_chars)


def any_of(words) -> str:
    """Regular expression that matches any of the words literally."""
    return "|".join(re.escape(w) for w in words)


def clause_aspects(clause: Column, lexicon: dict[str, tuple[str, ...]], lower: Column | None = None) -> Column:
    """Array of the aspects whose keywords occur in the clause, in lexicon order.

    ASCII keywords ignore case, others do not. A plain search for each keyword costs less than one
    pattern per aspect, which tries its keywords at every character. ``lower`` is the clause in
    lower case, if it is there already.
    """
    lower = F.lower(clause) if lower is None else lower
    tests = []
    for aspect, words in lexicon.items():
        found = [F.contains(lower, F.lit(w.lower())) if w.isascii() else F.contains(clause, F.lit(w)) for w in words]
        if found:
            tests.append(F.when(reduce(Column.__or__, found), F.lit(aspect)))
    return F.array_compact(F.array(*tests))


def hit_clauses(text: Column, cfg: C.AspectConfig) -> Column:
    """Distinct clauses that mention an aspect: array<struct<clause, aspects>>, all of them or
    the first ``clauses_per_review``. Row-local: no clause ever leaves its review."""
    distinct = F.array_distinct(clauses(text, cfg.clause_pattern, cfg.min_clause_chars))
    both = F.transform(distinct, lambda c: F.struct(c.alias("clause"), F.lower(c).alias("lower")))
    tagged = F.transform(
        both,
        lambda b: F.struct(b["clause"].alias("clause"), clause_aspects(b["clause"], cfg.lexicon, b["lower"]).alias("aspects")),
    )
    hits = F.filter(tagged, lambda h: F.size(h["aspects"]) > 0)
    return hits if cfg.clauses_per_review is None else F.slice(hits, 1, cfg.clauses_per_review)


def letter_runs(text: Column) -> Column:
    """Lower-cased runs of CJK ideographs and of other letters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[一-龥]+|[\p{L}&&[^一-龥]]+"), F.lit(0))


def word_tokens(text: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Tokens without a dictionary: lower-cased runs of letters. A run of CJK ideographs has no
    word boundaries and gives its overlapping n-grams of the given sizes."""
    runs = letter_runs(text)

    def grams(run: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(run) - (n - 1))
        made = F.transform(starts, lambda i: F.substring(run, i, F.lit(n)))
        return F.when(F.length(run) >= n, made).otherwise(F.array().cast("array<string>"))

    def tokens(run: Column) -> Column:
        return F.when(run.rlike("^[一-龥]"), F.concat(*[grams(run, n) for n in sizes])).otherwise(F.array(run))

    return F.flatten(F.transform(runs, tokens))


def characters(text: Column) -> Column:
    """Array of the code points of a text; empty for an empty text."""
    empty = F.array().cast("array<string>")
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(empty)
