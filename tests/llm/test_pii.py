"""Personal data against the plain patterns, one after another, and fixed cases of the added kinds."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from schemaloom.llm import pii

SCHEMA = "doc_id bigint, text string, spans string, kind int, _id string, _found int"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [None, "", "no data", "a@b.c@d.e", "x.@y.z..q @a.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 0.0.0.256", "é 4111 1111 1111 1111 😀 4111111111111112",
         "+1 (803) 555-5351 +1--2 +12345678 +1 23456789-", "call (803) 555-5351 now", "order (803) 555-5351 now", "IBAN DE89 3704 0044 0532 0130 00 AND on",
         "BE68 5390 0754 7034 AND", "DE89 3704 0044 0532 0130 01", "sku DE89370400440532013000", "ssn 123-45-6789, 000-12-3456", "123-45-6789",
         "tel 123-45-6789@x.org 415 555 1234"]


def base_of(text):
    out, text = [], text or ""
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            even = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 13 <= len(digits) <= 19 and (even + sum(digits[::-2])) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "1", "22", "255", "4111111111111111", "+1 ", "-", " ", "(", ")", "é", "😀", "\n", "555-5351", "x@y.z"]),
                max_size=40).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    assert [(k, a, b) for k, a, b, base, _ in pii.Finder().find(text) if base] == base_of(text)


def test_odd_rows(spark):
    rows = [(i, t, "x", 1, "y", 2) for i, t in enumerate(TEXTS)] + [(None, "a@b.c", None, None, None, None), (2**60 + 1, "a@b.c", None, None, None, None)] * 2
    got = pii.find(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(((r[0], *s) for r in rows for s in base_of(r[1])), key=repr)
    assert sorted(((r["doc_id"], s["kind"], s["start"], s["end"]) for r in got for s in r["spans"] if s["base"]), key=repr) == want
    added = {r["doc_id"]: [(s["kind"], TEXTS[r["doc_id"]][s["start"]:s["end"]]) for s in r["spans"] if not s["base"]]
             for r in got if r["doc_id"] in range(len(TEXTS))}
    assert {i: s for i, s in added.items() if s} == {
        8: [("tel", "803) 555-5351")], 10: [("iban", "DE89 3704 0044 0532 0130 00")], 11: [("iban", "BE68 5390 0754 7034")],
        14: [("ssn", "123-45-6789")], 16: [("tel", "415 555 1234")]}
    assert len(got) == len(rows) and pii.find(spark.createDataFrame([], SCHEMA)).count() == 0


def test_checksums():
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


def test_redact_keeps_the_other_columns(spark):
    rows = [(2**60 + 1, "to a@b.c or 1.2.3.4", "s", None, "i", 3), (None, None, None, None, None, None), (3, "é x", "s", 1, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = pii.redact(frame)
    assert out.schema.fieldNames() == frame.schema.fieldNames()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(2**60 + 1, "to [EMAIL] or [IP]", *rows[0][2:]), *rows[1:]], key=repr)


def test_query_lists(spark):
    frame = spark.createDataFrame([(1, "1.2.3.4 a@b.c")], "doc_id bigint, text string")
    row = pii.find(frame).select(pii.span_list(F.col("spans")).alias("s")).first()
    assert row["s"] == "email:8:13,ip:0:7" and len(hashlib.sha256(row["s"].encode()).hexdigest()) == 64


@pytest.mark.parametrize("text", ["a", "1", "1.", "1 ", "+1", "a@", "a.", "AB12", "1.1.1.1 ", "@", "415 555 1234 "])
def test_time_grows_with_the_text(text):
    def seconds(n):
        start = time.perf_counter()
        pii.Finder().find(text * (n // len(text)) + "@x.y")
        return time.perf_counter() - start

    assert seconds(1_600_000) < 30 * max(seconds(100_000), 0.002)
