"""Base kinds against their grammars as plain patterns over whole texts."""

import hashlib
import random
import re

import pytest

from tracewell.llm.pii import BASE_KINDS, find_spans, luhn, pii_spans, redact, redact_pii
from tracewell.llm.queries import QUERIES

GRAMMAR = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for order, kind in enumerate(BASE_KINDS):
        for m in re.finditer(GRAMMAR[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def own(text):
    return [s for s in find_spans(text) if s[0] in BASE_KINDS]


@pytest.mark.parametrize("alphabet", ["1.+@a ", "12.3-4 ()+", "ab.@-_%+é", "0123456789 -", "49.@:/ x+(\n٣"])
def test_random_texts(alphabet):
    rng = random.Random(alphabet)
    for _ in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert own(text) == base_spans(text), text


def test_examples():
    text = "Ümail bo.b+1@mail.example.com, 10.0.0.256 10.0.0.25, 4111 1111-1111 1111 +1 (319) 555-5132 https://me:pw@h.example/x password=7602ad27cf and token = \"ce0cc631\""
    kinds = [(k, text[a:b]) for k, a, b in find_spans(text)]
    assert ("email", "bo.b+1@mail.example.com") in kinds and ("ip", "10.0.0.25") in kinds
    assert ("card", "4111 1111-1111 1111") in kinds and ("phone", "+1 (319) 555-5132") in kinds
    assert ("login", "me:pw") in kinds and ("account", "7602ad27cf") in kinds and ("account", "ce0cc631") in kinds
    assert redact("a b@c.de +1 555 555 5555.", find_spans("a b@c.de +1 555 555 5555.")) == "a <EMAIL> <PHONE>."


@pytest.mark.parametrize("text,value", [
    ("IBAN: DE89 3704 0044 0532 0130 00 and more", "DE89 3704 0044 0532 0130 00"), ("IBAN DE89370400440532013000.", "DE89370400440532013000"),
    ("iban (GB29-NWBK-6016-1331-9268-19)", "GB29-NWBK-6016-1331-9268-19"), ("account no. NO93 8601 1117 947 x", "NO93 8601 1117 947"),
    ("IBAN: DE88 3704 0044 0532 0130 00", None), ("Iban numbers are long", None),
    ('{"token": "abcd1234"}', "abcd1234"), ("{'api_key' : 'abcd1234'}", "abcd1234"), ('{"iban": "DE89 3704 0044 0532 0130 00"}', "DE89 3704 0044 0532 0130 00"),
    ("account number: 12345678", "12345678"), ("Account No. 12345678", "12345678"), ("account: 1234 5678 9012, x", "1234 5678 9012"),
    ("account: 12345678abc", "12345678abc"), ("secret_key = abcd1234", "abcd1234"), ("accountNumber=12345678", "12345678"),
    ("token      =         abcd1234", "abcd1234"), ("password: p@ss!word", "p@ss!word"), ("password: p@ss!word, then", "p@ss!word"),
    ('password: "two words"', "two words"), (r'password="a\"b cd"', r'a\"b cd'), ('password: "never closed', "never"), ("?token=abcd1234&x=1", "abcd1234"),
    ("password=ab&cd,ef;gh", "ab&cd,ef;gh"), ("SSN 123-45-6789", "123-45-6789"), ("ssn: 123 45 6789", "123 45 6789"),
    ("the account was closed", None), ("password: abc", None), ("token" + " " * 100_000, None),
])
def test_account_forms(text, value):
    assert [text[a:b] for k, a, b in find_spans(text) if k == "account"] == ([] if value is None else [value])


def test_defined_cases(spark):
    long = "x " * 500_000 + "a@b.cd"
    rows = [(1, None, 9), (2, "", 9), (3, long, 9), (None, "a@b.cd", None), (3, long, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int").selectExpr("'c' AS spans", "'k' AS kind", "*")
    got = pii_spans(df).collect()
    assert [len(r.spans) for r in got] == [0, 0, 1, 1, 1]
    assert (got[2].spans[0].start, got[2].spans[0].end) == (1_000_000, 1_000_006)
    left = redact_pii(df, length_column="n_chars")
    assert left.columns == df.columns
    assert [r.text and r.text[-7:] for r in left.collect()] == [None, "", "<EMAIL>", "<EMAIL>", "<EMAIL>"]
    assert [r.n_chars for r in left.collect()] == [9, 0, 1_000_007, 7, 1_000_007]
    assert pii_spans(df.limit(0)).count() == 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op4_pii_spans"](spark, folder).collect():
        base = base_spans(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
        assert {tuple(map(str, s)) for s in base} <= {tuple(s.split(":")) for s in r.spans.split(",")}


def test_very_long_digit_runs():
    """Python refuses to read numbers of more than 4,300 digits."""
    for text, want in (("0" * 10_000 + ".1.1.1", True), ("0" * 10_000 + "255.0.0.0" + "0" * 9_000, True), ("9" * 10_000 + ".1.1.1", False), ("1.1.1." + "0" * 5_000 + "256", False)):
        assert [s for s in find_spans(text) if s[0] == "ip"] == ([("ip", 0, len(text))] if want else [])
    assert find_spans("card " + "4" * 20_000) == []
