"""SQL twins of the column builders, for the oracle queries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def low(c: str) -> str:
    return f"lower(coalesce({c}, ''))"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\s\\x0B]+', ' ', 'g'), ' ')"


def has_any(t: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ")"


def matches_any(t: str, patterns: Iterable[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({t}, {q(p)})" for p in patterns) + ")"


def count_of(t: str, words: Iterable[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({t}, {q(w)}) AS INT)" for w in words) + ")"


def first_alias(t: str, aliases: Mapping[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({t}, {q(a)}) THEN {q(n)}" for a, n in aliases.items()) + " END"


def best_bucket(t: str, buckets: Mapping[str, Iterable[str]], default: str) -> str:
    """The first bucket whose count is the greatest of all, if that is over 0."""
    counts = [count_of(t, ws) for ws in buckets.values()]
    top = "greatest(" + ", ".join(counts) + ")"
    return f"CASE WHEN {top} = 0 THEN {q(default)} " + " ".join(f"WHEN {c} = {top} THEN {q(n)}" for n, c in zip(buckets, counts)) + " END"


def clamp(c: str, a: float, b: float) -> str:
    return f"greatest({a}, least({b}, {c}))"


def yes(c: str, w: float) -> str:
    return f"(CASE WHEN {c} THEN {w} ELSE 0 END)"
