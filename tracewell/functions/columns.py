"""Column expressions shared by the operators. All stay on the JVM side."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions import fixed_values as fixed

# A number as free text writes it: digits may be grouped with underscores.
_DIGITS = r"\d+(?:_\d+)*"
NUMBER = (
    rf"[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|(?i:inf(?:inity)?))"
)
WHITE = " \t\n\r\f\x0b"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim every kind of white space, where trim() takes spaces only."""
    return F.btrim(c, F.lit(WHITE))


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    """True when any term occurs in c as a plain substring."""
    terms = list(terms)
    if not terms:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms])


def mentions(c: Column, terms: Iterable[str]) -> Column:
    """contains_any without regard to case, as one pattern.

    For filters: a filter repeats its input once per test, a pattern only once.
    """
    return c.rlike("(?i)" + "|".join(f"\\Q{t}\\E" for t in terms))


def first_match(c: Column, terms: Iterable[str]) -> Column:
    """The first term, in list order, that occurs in c; null when none does."""
    return F.coalesce(*[F.when(c.contains(t), F.lit(t)) for t in terms], F.lit(None))


def matched_terms(c: Column, terms: Iterable[str]) -> Column:
    """Every term that occurs in c, in list order."""
    terms = list(terms)
    listed = F.array(*[F.lit(t) for t in terms])
    nothing = F.array().cast("array<string>")
    # Most sentences hold no term; the plain test is far cheaper than the lambda.
    return F.when(contains_any(c, terms), F.filter(listed, lambda t: c.contains(t))).otherwise(
        nothing
    )


def numeric_prefix(c: Column) -> Column:
    """First white-space token of c as a double; null where it is not a number."""
    token = F.regexp_extract(c, rf"^\s*({NUMBER})(?:\s|$)", 1)
    return F.replace(token, F.lit("_"), F.lit("")).try_cast("double")


def lab_flag(name: Column, number: Column, rules: dict, cut: int) -> Column:
    """Strict comparison against the abnormal (cut=1) or critical (cut=2) limit."""
    low = {lab: rule[cut] for lab, rule in rules.items() if rule[0] == "low"}
    high = {lab: rule[cut] for lab, rule in rules.items() if rule[0] == "high"}
    return F.coalesce(number < lookup(name, low), F.lit(False)) | F.coalesce(
        number > lookup(name, high), F.lit(False)
    )


def lookup(c: Column, values: dict) -> Column:
    """Map c through a small fixed dictionary; null where the key is unknown."""
    if not values:
        return F.lit(None)
    return F.element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), c)


def normal_name(c: Column, synonyms: dict = fixed.NAME_SYNONYMS) -> Column:
    """Known synonyms to one spelling, anything else trimmed."""
    trimmed = strip(text_or_empty(c))
    key = F.regexp_replace(F.lower(trimmed), r"\s+", " ")
    return F.coalesce(lookup(key, synonyms), trimmed)


def general_number(c: Column) -> Column:
    """Six significant digits without trailing zeros, as C's %g prints."""
    padded = F.format_string("%.6g", c)
    short = F.regexp_replace(padded, r"(\.\d*?)0+(e|$)", "$1$2")
    return F.when(c.isNotNull(), F.regexp_replace(short, r"\.(e|$)", "$1"))


def iso_text(ts: Column) -> Column:
    """ISO 8601 without zone; the fraction appears only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def content_id(kind: Column, ts: Column, value: Column, details: Column) -> Column:
    """Event id from content, so the same row delivered twice is the same event."""
    raw = F.concat_ws("|", kind, iso_text(ts), text_or_empty(value), text_or_empty(details))
    return F.substring(F.sha1(raw), 1, 16)


def parse_time(c: Column) -> Column:
    """ISO text to timestamp; blank or malformed is null."""
    return F.try_to_timestamp(F.replace(strip(c), F.lit("Z"), F.lit("")))


def required_format(c: Column) -> Column:
    """ISO text to timestamp; blank is null, anything else that is no time is an error."""
    unreadable = F.raise_error(F.concat(F.lit("not a time: "), c)).cast("timestamp")
    return F.when(strip(text_or_empty(c)) != "", F.coalesce(parse_time(c), unreadable))


def whole_age(c: Column) -> Column:
    """Age text to a whole number; blank or malformed is 0."""
    number = F.regexp_extract(c, rf"^\s*({NUMBER})\s*$", 1).try_cast("double")
    return F.coalesce(number.try_cast("int"), F.lit(0))


def years_between(born: Column, at: Column) -> Column:
    """Whole years by elapsed days over 365.25, never negative."""
    days = F.floor((F.unix_micros(at) - F.unix_micros(born)) / F.lit(86400e6))
    years = F.floor(days / F.lit(365.25)).cast("int")
    return F.when(years < 0, 0).otherwise(years)


def days_between(earlier: Column, later: Column) -> Column:
    """Elapsed fractional days."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400e6)


def waiting_days(discharged: Column, now: Column) -> Column:
    """Whole days since discharge, never negative; null while still in house."""
    days = F.floor(days_between(discharged, now)).cast("int")
    return F.when(days < 0, 0).otherwise(days)


def score_band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def seeded_hash(seed, c: Column) -> Column:
    """32 hex digits, uniform over ids and the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")))


def seeded_draw(seed, c: Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the seeded hash."""
    return F.conv(F.substring(seeded_hash(seed, c), 1, 8), 16, 10).cast("bigint") / F.lit(
        4294967296.0
    )


def seeded_int(seed, c: Column, low: int, high: int) -> Column:
    """Uniform whole number in [low, high]."""
    return (F.lit(low) + F.floor(seeded_draw(seed, c) * F.lit(high - low + 1))).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; null when b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))
