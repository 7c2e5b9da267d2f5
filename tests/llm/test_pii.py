"""Personal data: base spans against plain regular expressions, added spans on examples."""

import hashlib
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wakeline.llm import pii

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(Decimal(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(n // 10 + n % 10 for n in doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    """Base spans by start, then kind."""
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if holds(kind, m[0])]
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def written(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_base_spans_of_random_texts():
    draw = random.Random(5)
    finder = pii.Finder()
    parts = [*"0123456789" * 3, *"@..+-- ()ab_%é\n😀İ", "4111111111111111", "4111-1111 1111-1111", "a@b.c", "10.0.0.1", "256.1.1.1", "+1 (743) 555-3824", "://", "token=", "iban "]
    for _ in range(30_000):
        text = "".join(draw.choices(parts, k=draw.randint(1, 30)))
        got = finder.spans(text)
        assert [s for s in got if s[0] in pii.BASE_KINDS] == plain(text), text


@pytest.mark.parametrize(
    "text",
    ["", "@", "a@b", "@b.c", "a@b.c@d.e", "a@b..c", "a@b.c.", "x a@b.c_d@e.f y", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "000255.1.1.1", "1." * 9, "+", "+1", "+12", "+1 2", "+1234567890", "++1 234 567 8901 ) -", "+1-234-567-890-123-456-7",
     "4111111111111111", "4111 1111-1111 1111", "4111  1111 1111 1111", "4111111111111112", "1" * 5000 + ".1.1.1", "0" * 14, "é 4111111111111111 é", "x" * 50_000 + "a@b.c", "1-" * 30_000 + "1"],
)
def test_base_spans_at_edges(text):
    assert [s for s in pii.Finder().spans(text) if s[0] in pii.BASE_KINDS] == plain(text)


def added(text):
    return [(k, text[s:e]) for k, s, e in pii.Finder().spans(text) if k in pii.ADDED_KINDS]


def test_added_spans():
    assert added('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == [("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    assert added("the token economy = something") == added("tokens = 24be64439e3e49cf46b2d7c90f") == added("password: abcdefghijklmnopqrst") == []
    assert added("IBAN DE89 3704 0044 0532 0130 00 AND MORE") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert added("iban: GB82WEST12345698765432, then") == [("iban", "GB82WEST12345698765432")] and added("iban: GB82WEST12345698765433") == []
    assert added("ssn 078-05-1120.") == [("ssn", "078-05-1120")] and added("Account no. 12345678") == [("account", "12345678")]
    assert added("accounts 12345678") == [] and added("on account of 5 men") == []
    assert added("see http://ann:pass@host/x and http://[2001:db8::1]/y, not http://[12:34]/") == [("login", "ann:pass"), ("ip6", "2001:db8::1")]
    assert added("account 4111111111111111") == []  # a base span already


def test_documents_of_all_kinds(spark):
    long = "clean words here " * 60_000 + "end a@b.org"
    texts = [None, "", "mail ann@example.com, call +1 (743) 555-3824", long, "plain text"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[2]), (2, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("x"), "n_ip": F.lit(None).cast("int")})
    got = pii.personal_digests(pii.find_personal(df)).collect()
    assert sorted((str(r.doc_id), r.spans, r.n_email, r.n_phone) for r in got) == sorted((str(i), written(plain(t)), len(re.findall("@", t or "")), len(re.findall(r"\+", t or ""))) for i, t in rows)
    assert pii.find_personal(df.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in pii.redacted(df.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert clean[0] is None and clean[1] == "" and clean[2] == "mail <email>, call <phone>" and clean[3] == long[:-7] + "<email>" and clean[4] == "plain text"


def test_query_over_all_documents(spark):
    got = {r.doc_id: r for r in entry.queries()["op11_pii"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs) and any(r.spans for r in got.values())
    for d in docs:
        base, r = plain(d.text), got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in PATTERNS]
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if s.split(":")[0] in PATTERNS] == written(base).split(",") * bool(base)
