"""Small builders for oracle SQL text."""

from __future__ import annotations

from collections.abc import Iterable


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values: Iterable[str]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def sql_any(column: str, terms: Iterable[str]) -> str:
    """True when any term occurs in column."""
    return "(" + " OR ".join(f"contains({column}, {quoted(t)})" for t in terms) + ")"


def sql_iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
