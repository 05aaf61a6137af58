"""Spans against the stated patterns run by Python's own engine."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillwise.llm import pii

# The patterns as the contract states them.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * 2 if k % 2 else int(d) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(part) <= 255 for part in match.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def plain_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in STATED.items()
        for m in re.finditer(pattern, text or "")
        if passes(kind, m.group())
    ]


TEXTS = [
    None,
    "",
    "a@b.c@d.e x%d@e.f a@b a@@b.c .@-.- é@x.y",
    "a@b.c%d@e.f.g_h@i.j",
    "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.0 1.1.1 1..2.3.4.5 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 12345678901234567890 0000000000000",
    "+1 (555) 010-9999 +49.30.1234567 +1- ++123456789 +123456789012345678",
    "é" * 50 + "mail me: jörg@exämple.org j@example.org, 😀 card 4111111111111111",
    "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, not DE88370400440532013000",
    "1" * 5000 + " " + "a." * 3000 + "@x." + "b." * 3000 + "c",
    " ".join(f"1.1.1.{k % 300}" for k in range(3000)),
    "x" * 120_000,
]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.span_digests(pii.find_spans(docs)).collect()}


def check(spark, texts):
    got = found(spark, texts)
    for k, text in enumerate(texts):
        expected = plain_spans(text)
        base = ",".join(f"{kind}:{start}:{end}" for kind, start, end in expected)
        assert got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), text
        assert [got[k][f"n_{kind}"] for kind in STATED] == [sum(s[0] == kind for s in expected) for kind in STATED]
        assert ",".join(s for s in got[k].spans.split(",") if not s.startswith("iban")) == base


def test_stated_spans(spark):
    check(spark, TEXTS)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("a@.-+%0123456789 ()é\n_", max_size=60), min_size=100, max_size=200))
def test_random_texts(spark, texts):
    check(spark, texts)


def test_checked_account_numbers_and_context(spark):
    got = found(spark, TEXTS)[8]
    assert got.n_iban == 2 and "iban:5:32" in got.spans
    docs = spark.createDataFrame([(1, "mail a@b.cd"), (2, "zzz a@b.cd")], "doc_id long, text string")
    assert [[s.score for s in r.spans] for r in pii.find_spans(docs).orderBy("doc_id").collect()] == [[1.0], [0.8]]


def test_repeated_rows_null_ids_other_columns_empty(spark):
    rows = [(None, "a@b.cd", 1), (3, "a@b.cd", 2), (3, "a@b.cd", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    assert sorted(str(r.doc_id) for r in pii.find_spans(docs).collect()) == ["3", "3", "None"]
    assert pii.find_spans(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", pii.KINDS, ids=lambda k: k.name)
def test_patterns_take_linear_time(kind):
    # Possessive runs and one-sided guards only: no nested unbounded choice.
    assert not re.search(r"[+*]\)[+*](?!\+)", kind.pattern)
