"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the few places where personal data can be: at-signs,
plus signs, digits, `://` and account cues. From each anchor a deterministic parser
expands to the boundaries of its kind and validates what it finds, so the rest of a text
is never looked at by a pattern.

Kinds `email`, `ip`, `card` and `phone` follow fixed grammars, leftmost and
non-overlapping per kind; a match that fails its check is dropped and not tried again:

- email: local part, at-sign, host of two labels or more
- ip: four groups of digits with dots, each at most 255
- card: digits with single blanks or hyphens between, 12 to 19 digits, Luhn
- phone: plus, digits with blanks, dots, brackets or hyphens between, 9 to 15 digits

The method adds two kinds: `login` (user and password of a URL, from `://` to the at-sign
before the host) and `account` (the value behind a cue such as `password=`, `"token": "..."`,
`account number: ...`):

- the cue may go on in joined words (`_key`, `number`, `no.`) and end in a quote; blanks are not limited
- IBAN (cues `iban` and `account`): groups of letters and digits, with or without a colon; the length of its
  country and mod 97. Behind `iban` nothing else is a value, behind `account` anything is that follows `:` or `=`
- `ssn`: 3, 2 and 4 digits, with or without a colon, no part zero; else as below
- `account`: all groups of its digits, also without a colon if `number` or `no.` goes before
- others: what a quote encloses on its line, or a run without blanks; 4 characters or more

Positions are code points, end exclusive. Defined cases: null and empty texts have no
spans; overlapping spans of different kinds are all reported; redaction replaces
overlapping spans by the tag of the first (the longest, if several start there); repeated rows are
treated alike; columns other than the text pass through.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import words as W

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "account")
# Words that announce an identifier.
CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "iban", "ssn", "account")

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://([^\s/?#@]+)@")
_JOINED = re.compile(r"(?:[\x20\t]*+[_.-]?[\x20\t]*+(?:(?:keys?|numbers?|ids?|codes?|values?|hash|phrase)(?![a-z0-9])|(?:no|nr|num)(?:\.|(?![a-z0-9]))|\#))*+")
_IS = re.compile(r"[\"'`]?[\x20\t]*+[:=][=>]?[\x20\t]*+")
_BEFORE_NUMBER = re.compile(r"[\x20\t:=(\[\"'`]++")
_QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\.){4,}+)\"|'((?:[^'\\\n]|\\.){4,}+)'")
# Quotes inside of a run belong to it; a comma, semicolon or ampersand before the next `name=` does not.
_RUN = re.compile(r"[\"']?((?:(?![&,;][\w.-]*+[:=])[^\s\"'<>]|[\"'](?=[^\W_]))++)")
_GROUPS = re.compile(r"[0-9]{2,}+(?:[\x20-][0-9]{2,}+)*+(?![A-Za-z0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([\x20-]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9])")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[\x20\t\xa0-]?[A-Za-z0-9]){11,30}")
# Characters of an IBAN by country; others may have 15 to 34.
IBAN_LENGTHS = {code: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}.items() for code in codes.split()}
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for digit in "0123456789":
        machine.add_word(digit, ("digit", 1))
    machine.add_word("@", ("at", 1))
    machine.add_word("+", ("plus", 1))
    machine.add_word("://", ("scheme", 3))
    for cue in CUES:
        machine.add_word(cue, (cue, len(cue)))
    machine.make_automaton()
    return machine


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _iban_end(text: str, at: int) -> int | None:
    """Where an IBAN that starts at `at` ends."""
    m = _IBAN.match(text, at)
    if not m:
        return None
    ends = [i + 1 for i in range(at, m.end()) if text[i].isalnum()]
    whole = "".join(text[i - 1] for i in ends).upper()
    length = IBAN_LENGTHS.get(whole[:2])
    for n in [length] if length else range(len(ends), 14, -1):
        if n <= len(ends) and not text[ends[n - 1]:ends[n - 1] + 1].isalnum() and mod97(whole[:n]):
            return ends[n - 1]
    return None


def _account(text: str, lowered: str, cue: str, after: int) -> tuple[int, int] | None:
    """Start and end of the value behind a cue that ends before `after`."""
    joined = _JOINED.match(lowered, after).end()
    said = _IS.match(text, joined)
    before = _BEFORE_NUMBER.match(text, joined)
    at = before.end() if before else joined
    if before or joined > after:
        if cue in ("iban", "account") and (end := _iban_end(text, at)):
            return at, end
        if cue == "ssn" and (m := _SSN.match(text, at)):
            return m.span()
        if cue == "account" and (said or joined > after) and (m := _GROUPS.match(text, at)) and len(m[0]) >= 4:
            return m.span()
    if not said or cue == "iban":
        return None
    if m := _QUOTED.match(text, said.end()):
        return m.span(m.lastindex)
    if m := _RUN.match(text, said.end()):
        start, end = m.span(1)
        end = start + len(m[1].rstrip(".,;:?)]}"))
        if end - start >= 4:
            return start, end
    return None


def _lower(text: str) -> str:
    """A-Z in lower case; other letters stay, so that positions hold."""
    return text.translate(_TO_LOWER)


_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start and then in the order of KINDS."""
    found: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)      # where the last match of a kind ended, kept or not
    lowered = _lower(text)
    for last, (anchor, size) in _anchors().iter(lowered):
        at = last - size + 1
        if anchor == "digit":
            if at and text[at - 1] in _DIGITS and at > done["ip"] and at > done["card"]:
                continue                # inside a run that was tried from its start
            if at >= done["ip"] and (m := _IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(g) <= 3 and int(g) <= 255 for g in (g.lstrip("0") or "0" for g in m.groups())):
                    found.append(("ip", at, m.end()))
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = _only_digits(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", at, m.end()))
        elif anchor == "at":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at and (m := _HOST.match(text, at)):
                done["email"] = m.end()
                found.append(("email", start, m.end()))
        elif anchor == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= len(_only_digits(m[0])) <= 15:
                    found.append(("phone", at, m.end()))
        elif anchor == "scheme":
            if at >= done["login"] and (m := _LOGIN.match(text, at)):
                done["login"] = m.end()
                found.append(("login", m.start(1), m.end(1)))
        elif at >= done["account"] and (at == 0 or not text[at - 1].isalnum()) and (span := _account(text, lowered, anchor, last + 1)):
            done["account"] = span[1]
            found.append(("account", *span))
    found.sort(key=lambda s: (s[1], _ORDER[s[0]]))
    return found


_ORDER = {kind: i for i, kind in enumerate(KINDS)}


def tags(spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, tag) for each span or run of overlapping spans, left to right."""
    out: list[tuple[int, int, str]] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], _ORDER[s[0]])):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2])
        else:
            out.append((start, end, f"<{kind.upper()}>"))
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a tag such as `<EMAIL>` for each span or run of overlapping spans."""
    out, at = [], 0
    for start, end, tag in tags(spans):
        out += [text[at:start], tag]
        at = end
    return "".join([*out, text[at:]])


def _spans(batches):
    for batch in batches:
        rows = [
            [{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t.as_py())]
            for t in W.plain_strings(batch.column("text"))
        ]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        yield pa.record_batch([batch.column("doc_id"), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])


def pii_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row."""
    base = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return base.mapInArrow(_spans, "doc_id bigint, spans array<struct<kind: string, start: int, end: int>>")


def _edits(batches):
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
    for batch in batches:
        rows = [
            [{"start": a, "end": b, "text": tag} for a, b, tag in reversed(tags(find_spans(t.as_py())))]
            for t in W.plain_strings(batch.column("text"))
        ]
        yield pa.record_batch([batch.column("doc_id"), batch.column("text"), pa.array(rows, pa.list_(kind))], ["doc_id", "text", "edits"])


def redaction_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text and the edits that redact it, right to left, so that none moves another."""
    base = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return base.mapInArrow(_edits, "doc_id bigint, text string, edits array<struct<start: int, end: int, text: string>>")


def redact_pii(docs: DataFrame, text_column: str = "text", length_column: str | None = None) -> DataFrame:
    """docs with redacted texts; length_column, if given, gets the new number of code points."""
    place = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redact(t, find_spans(t)) for t in batch.column(place).to_pylist()]
            columns = batch.columns
            columns[place] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if length_column is not None:
        kind = docs.schema[length_column].dataType
        out = out.withColumn(length_column, F.coalesce(F.length(text_column).cast(kind), F.col(length_column)))
    return out
