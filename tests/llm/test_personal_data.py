import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cases import LONG, edge_docs, no_docs
from plaudit.llm import personal_data as X

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """The base by its patterns, each over the whole text."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PATTERNS).index(kind), m.end()))
    return [(list(PATTERNS)[k], a, b) for a, k, b in sorted(out)]


def base(text):
    return [s for s in X.find_spans(text) if s[0] in X.BASE]


def added(text):
    return {(k, text[a:b]) for k, a, b in X.find_spans(text) if k not in X.BASE}


@pytest.mark.parametrize("alphabet", ["0123456789 -.", "ab@.-1", "+0123 ()-.", "a@é.:1/ +-token=", "4000000000 -.+@"])
def test_base_against_patterns(alphabet):
    rnd = random.Random(alphabet)
    for _ in range(6000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        assert base(text) == brute(text), text


def test_base_on_planted_numbers():
    rnd = random.Random(5)
    for _ in range(2000):
        digits = "".join(rnd.choice("0123456789") for _ in range(rnd.randint(11, 19)))
        check = next(c for c in "0123456789" if X.luhn(digits + c))
        text = rnd.choice(["", "x", "1.", "+", "-"]) + rnd.choice([digits + check, " ".join(digits) + "-" + check, "7" + digits + check]) + rnd.choice(["", " 5", ".5"])
        assert base(text) == brute(text), text
    assert [s[0] for s in base("4111 1111 1111 1111")] == ["card"] and base("4111 1111 1111 1112") == []


@pytest.mark.parametrize("text, want", [
    ("write josé.nuñez@correo.es now", {("contact", "josé.nuñez@correo.es")}),
    ("bob.smith (at) mail (dot) example (dot) org.", {("contact", "bob.smith (at) mail (dot) example (dot) org")}),
    ("bob at mail dot com", {("contact", "bob at mail dot com")}),
    ("we met at noon. It was fine at example.com", set()),
    ("ana＠mail.example", {("contact", "ana＠mail.example")}),
    ("IBAN DE89 3704 0044 0532 0130 00 IS MINE", {("iban", "DE89 3704 0044 0532 0130 00")}),
    ("DE89370400440532013001", set()),
    ("at 2001:db8::ff00:42:8329, or 12:30:45, std::add", {("ipv6", "2001:db8::ff00:42:8329")}),
    ("eth 00:1A:2b:3C:4d:5E up, 00-1A-2b-3C-4d-5E", {("mac", "00:1A:2b:3C:4d:5E"), ("mac", "00-1A-2b-3C-4d-5E")}),
    ("see https://ann:pw@host.org/x, http://a.org/~ann/. and https://www.apache.org/licenses/", {("url", "https://ann:pw@host.org/x"), ("url", "http://a.org/~ann/")}),
    ("mailto:ann@host.org tel:+1-202-555-0100 hotel:5", {("url", "mailto:ann@host.org"), ("url", "tel:+1-202-555-0100")}),
    ('token = "04dbebab91ab85687d33", tokens = 5, the token is lost', {("account", "04dbebab91ab85687d33")}),
    ("Account number: 00123-4567. SSN: 078-05-1120; PASSWORD: hunter22", {("account", "00123-4567"), ("account", "078-05-1120"), ("account", "hunter22")}),
    ("Licensed under CC BY-NC 4.0. Version 2.0, chapter 3.", set()),
])
def test_added(text, want):
    assert added(text) == want


def test_long_texts_are_read_in_time():
    for text in ("9" * 200_000, "a@" * 100_000, ":" * 200_000, "+1 " * 60_000, "token=" * 40_000, "1." * 100_000, LONG, "AB12 " * 40_000, "é@" * 50_000):
        X.find_spans(text)


def test_rows(spark):
    docs = edge_docs(spark)
    found = X.personal_data(docs, into="hits")
    assert found.columns == [*docs.columns, "hits"] and found.drop("hits").collect() == docs.collect()
    assert X.personal_data(no_docs(spark)).count() == 0
    texts = ["é a.b@c.de 10.0.0.1", None, "", "é a.b@c.de 10.0.0.1", "mail ann@x.org or +1 (202) 555-0100"]
    got = X.personal_data(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), into="s")
    rows = got.select("id", X.joined(F.col("s")).alias("j"), X.masked(F.col("text"), F.col("s")).alias("m")).orderBy("id").collect()
    assert [r["j"] for r in rows] == ["email:2:10,ip:11:19", "", "", "email:2:10,ip:11:19", "email:5:14,phone:18:35"]
    assert [r["m"] for r in rows] == ["é [email] [ip]", None, "", "é [email] [ip]", "mail [email] or [phone]"]


def test_query(spark):
    from conftest import SF

    got = X.op12_personal_data(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    assert len(got) == len(docs)
    for i, text in docs.itertuples(index=False):
        want = brute(text)
        row = got.loc[i]
        assert [row[f"n_{k}"] for k in X.BASE] == [sum(s[0] == k for s in want) for k in X.BASE]
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert set(",".join(f"{k}:{a}:{b}" for k, a, b in want).split(",")) - {""} <= set(row["spans"].split(","))
