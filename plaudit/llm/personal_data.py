"""Personal data in texts: anchors found by an Aho-Corasick automaton, grown by local parsers.

One pass of the automaton over the text finds at-signs, digits, plus signs, colons, schemes and
identifier cues. At each anchor a small deterministic parser grows the match to both sides, checks
it, and says where it ends; an anchor inside a match of its kind is not looked at again. Texts
without anchors cost the pass alone, and no parser looks at a character more than a few times.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import bounded_batches, map_columns, table

#: Kinds in the order in which spans with one start are listed; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "contact", "iban", "ipv6", "mac", "url", "account")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
HEX = frozenset("0123456789abcdefABCDEF:")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
RUN = re.compile(r"[0-9]+")
QUAD = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}")
MAC = re.compile(r"[0-9A-Fa-f]{2}([:-])[0-9A-Fa-f]{2}(?:\1[0-9A-Fa-f]{2}){4}(?![0-9A-Za-z:-])")
COLONS = re.compile(r"[0-9A-Fa-f:]*(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3})?")
#: A mailbox with letters outside ASCII, or one that is written out.
WIDE_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
SPELT = re.compile(r"\s{0,2}([A-Za-z0-9-]+(?:\s{0,2}(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s{0,2}[A-Za-z0-9-]+)*\s{0,2}(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s|\.)\s{0,2}[A-Za-z]{2,})")
URL_BODY = re.compile(r"[^\s\"'<>`{}|\\^\[\]]+")
ADDRESS = re.compile(r"[A-Za-z0-9._%+@:;=?&,()-]+")
PERSONAL_URL = re.compile(
    r"^[^/?#]*:[^/?#]*@|^[^/?#]+/(?:~|@|users?/|profiles?/|people/|in/|u/)[\w.%-]|[?&;](?:e?mail|user(?:name)?|uid|phone|tel|token|key|password|pwd|session)=[^&#]",
    re.IGNORECASE,
)
VALUE = re.compile(
    r"(?:[\x20_-]?(?:no\.?|number|nr\.?|id|key|code|#))?[\x20\t]{0,4}(?:[:=#]|\bis\b)[\x20\t]{0,4}([\"']?)([A-Za-z0-9][A-Za-z0-9+/_=.-]*)\1",
    re.IGNORECASE,
)

SCHEMES = ("http://", "https://", "ftp://", "ftps://", "sftp://", "ssh://", "mailto:", "tel:", "sip:", "sips:", "xmpp:", "sms:", "skype:")
CUES = (
    "token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "api key", "api-key", "access key", "access_key", "private key",
    "account", "acct", "iban", "ssn", "social security", "passport", "tax id", "tax_id", "driver license", "license plate",
    "customer id", "member id", "user id", "user_id", "username", "login", "routing", "sort code", "konto", "kontonummer", "compte", "cuenta",
    "ausweis", "steuernummer", "contraseña", "mot de passe", "passwort", "kennwort",
)
SPELT_AT = ("(at)", "[at]", "{at}", "(AT)", "[AT]", " at ", " AT ", "＠")
#: Accounts of fewer characters are not told from words and counts.
LEAST_VALUE = 6


@cache
def automaton() -> ahocorasick.Automaton:
    """Anchors with what they start and their length; cues in lower, upper and title case."""
    made = ahocorasick.Automaton()
    for sign in "0123456789":
        made.add_word(sign, ("digit", 1))
    made.add_word("@", ("at", 1))
    made.add_word("+", ("plus", 1))
    made.add_word(":", ("colon", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
        for word in words:
            for form in {word, word.upper(), word.capitalize(), word.title()}:
                made.add_word(form, (kind, len(form)))
    for word in SPELT_AT:
        made.add_word(word, ("spelt", len(word)))
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(code: str) -> bool:
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


class Finder:
    """The parsers of one text. Each keeps the place up to which its kind has been read."""

    def __init__(self, text: str):
        self.text = text
        self.read = dict.fromkeys(KINDS, 0)
        self.spans: list[tuple[int, int, int]] = []

    def add(self, kind: str, start: int, end: int) -> None:
        self.spans.append((start, KINDS.index(kind), end))
        self.read[kind] = max(self.read[kind], end)

    def at(self, i: int, _: int) -> None:
        t, lo, floor = self.text, i, self.read["email"]
        while lo > floor and t[lo - 1] in LOCAL:
            lo -= 1
        host = HOST.match(t, i + 1)
        if lo < i and host:
            self.add("email", lo, host.end())
        self._wide(i, lo, host)

    def _wide(self, i: int, lo: int, host: re.Match | None) -> None:
        """A mailbox with letters outside ASCII: its whole extent, of which the base sees a part."""
        t, floor = self.text, self.read["contact"]
        while lo > floor and i - lo < 64 and (t[lo - 1].isalnum() or t[lo - 1] in LOCAL):
            lo -= 1
        end = (WIDE_HOST.match(t, i + 1) or host or re.match("", t)).end()
        if lo < i < end and not t[lo:end].isascii():
            self.add("contact", lo, end)

    def spelt(self, i: int, n: int) -> None:
        """``name (at) host (dot) org`` and the like; a plain `` at `` needs a written ``dot``."""
        t = self.text
        lo = end = i
        while lo > self.read["contact"] and i - lo < 2 and t[lo - 1] == " ":
            lo -= 1
        end = lo
        while lo > self.read["contact"] and end - lo < 64 and t[lo - 1] in LOCAL:
            lo -= 1
        host = SPELT.match(t, i + n)
        if lo == end or host is None:
            return
        if t[i : i + n].strip().lower() == "at" and not re.search(r"\bdot\b", host[1]):
            return
        self.add("contact", lo, host.end(1))

    def digit(self, i: int, _: int) -> None:
        t, read = self.text, self.read
        if i >= read["ip"]:
            m = QUAD.match(t, i)
            if m:
                read["ip"] = m.end()
                if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                    self.add("ip", i, m.end())
            else:
                read["ip"] = RUN.match(t, i).end()
        if i >= read["card"]:
            m = CARD.match(t, i)
            if m:
                read["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    self.add("card", i, m.end())
        if i >= 2 and i >= read["iban"] and "A" <= t[i - 1] <= "Z" and "A" <= t[i - 2] <= "Z" and not t[i - 3 : i - 2].isalnum():
            self._iban(i - 2)
        if i >= read["mac"] and not (t[i - 1 : i].isalnum() or t[i - 1 : i] in ("-", ":")) and (m := MAC.match(t, i)):
            self.add("mac", i, m.end())

    def _iban(self, start: int) -> None:
        """The longest reading with right check digits; groups of four may stand apart."""
        m = IBAN.match(self.text, start)
        end = m.end() if m else start
        while end - start >= 15:
            code = self.text[start:end].replace(" ", "")
            if not self.text[end : end + 1].isalnum() and self.text[end - 1] != " " and iban_ok(code):
                self.add("iban", start, end)
                return
            end -= 1
        if m:
            self.read["iban"] = m.end()

    def plus(self, i: int, _: int) -> None:
        if i < self.read["phone"]:
            return
        m = PHONE.match(self.text, i)
        if m:
            self.read["phone"] = m.end()
            if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                self.add("phone", i, m.end())

    def colon(self, i: int, _: int) -> None:
        t, floor = self.text, self.read["ipv6"]
        if i < floor:
            return
        lo = i
        while lo > floor and i - lo < 4 and t[lo - 1] in HEX:
            lo -= 1
        m = COLONS.match(t, lo)
        end = m.end()
        self.read["ipv6"] = end
        while end > lo and t[end - 1] == ":" and t[end - 2 : end - 1] != ":":
            end -= 1
        if t[lo:end].count(":") < 2 or end - lo < 6 or t[lo - 1 : lo].isalnum() or t[end : end + 1].isalnum():
            return
        if MAC.match(t, lo):
            self.add("mac", lo, MAC.match(t, lo).end())
            return
        try:
            ipaddress.IPv6Address(t[lo:end])
        except ValueError:
            return
        self.add("ipv6", lo, end)

    def scheme(self, i: int, n: int) -> None:
        """An address with a mailbox, a number, a login or a person's page in it; others stay."""
        t = self.text
        if i < self.read["url"] or t[i - 1 : i].isalnum():
            return
        slashes = t[i + n - 1] == "/"
        m = (URL_BODY if slashes else ADDRESS).match(t, i + n)
        if m is None:
            return
        body = m[0].rstrip(".,;:!?)'\"")
        end = i + n + len(body)
        self.read["url"] = end
        if PERSONAL_URL.search(body) or HOST.match(body.partition("@")[2]) or not slashes and sum(c in DIGITS for c in body) >= 7:
            self.add("url", i, end)

    def cue(self, i: int, n: int) -> None:
        """What a cue names: a value after a sign, with a digit, of LEAST_VALUE characters."""
        t = self.text
        if i < self.read["account"] or t[i - 1 : i].isalpha():
            return
        m = VALUE.match(t, i + n)
        if m is None:
            return
        start, end = m.span(2)
        while end > start and t[end - 1] in ".-/":
            end -= 1
        self.read["account"] = end
        if end - start >= LEAST_VALUE and any(c in DIGITS for c in t[start:end]):
            self.add("account", start, end)


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by kind; code points, the end is exclusive."""
    if not text:
        return []
    finder = Finder(text)
    for last, (kind, n) in automaton().iter(text):
        getattr(finder, kind)(last - n + 1, n)
    return [(KINDS[k], start, end) for start, k, end in sorted(set(finder.spans))]


def personal_data(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with ``into``: array<struct<kind, start, end>> of all personal data in the text.

    Kinds: email, ip, card and phone as the base patterns define them, leftmost and not overlapping
    within a kind; contact (mailboxes with other letters or written out), iban, ipv6, mac, url (with
    a login, mailbox, number or person's page) and account (what a cue such as ``token =`` names).
    Spans of different kinds may overlap. Null and empty texts have none; texts of any length are
    read whole, in one pass. Rows stay as they are, repeated ones and ties too, and an empty table
    gives an empty one. Other columns pass through; one named ``into`` is replaced.
    """
    bounded_batches(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> tuple[None, dict[str, list]]:
        found = (find_spans(t) for t in _texts(batch.column(text)))
        return None, {into: [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]}

    return map_columns(docs, work, {into: "array<struct<kind: string, start: int, end: int>>"})


def _texts(column: pa.Array) -> Iterator[str | None]:
    return (v.as_py() for v in column)


def joined(spans: Column, kinds: Iterable[str] = KINDS) -> Column:
    """``kind:start:end`` of the spans of these kinds, with commas between."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping ones are one, named
    by the first. Null stays null."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        new = s["start"] >= done["at"]
        more = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(new, more).otherwise(done["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def op12_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    spans = F.col("spans")
    counts = [F.size(F.filter(spans["kind"], lambda x: x == F.lit(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(spans, BASE), 256).alias("base_sha256"), joined(spans).alias("spans"))


QUERIES = {"op12_personal_data": op12_personal_data}
ORACLES: dict[str, str] = {}
