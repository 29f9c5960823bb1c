"""Physical dimensions of formulas: products, quotients, powers and sums of known symbols."""

from __future__ import annotations

import re

# Exponents of symbols over (length, mass, time, current, temperature).
SYMBOLS = {"m": (0, 1, 0, 0, 0), "F": (1, 1, -2, 0, 0), "a": (1, 0, -2, 0, 0), "v": (1, 0, -1, 0, 0), "t": (0, 0, 1, 0, 0), "x": (1, 0, 0, 0, 0), "E": (2, 1, -2, 0, 0), "p": (1, 1, -1, 0, 0), "T": (0, 0, 0, 0, 1), "I": (0, 0, 0, 1, 0), "q": (0, 0, 1, 1, 0), "V": (2, 1, -3, -1, 0), "W": (2, 1, -2, 0, 0), "P": (2, 1, -3, 0, 0)}
#: Constants that count as numbers.
NUMBERS = ("pi", "e", "c0", "k", "hbar", "alpha")

_TOKEN = re.compile(r"\s*(\d+(?:\.\d+)?|[A-Za-z_]\w*|\*\*|[-+*/^()])")


class UnknownSymbol(ValueError):
    """A formula has a symbol or form whose dimension isn't known."""


def dimension(formula: str) -> tuple[int, ...] | None:
    """Dimension of a formula, or None if a symbol is unknown, terms disagree or it can't be read."""
    tokens, at = [], 0
    text = formula.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        tokens.append("^" if m[1] == "**" else m[1])
        at = m.end()
    try:
        dim, rest = _sum(tokens)
    except (UnknownSymbol, IndexError):
        return None
    return dim if not rest else None


def _sum(ts: list[str]) -> tuple[tuple[int, ...], list[str]]:
    if ts[0] in "+-":
        ts = ts[1:]
    dim, ts = _product(ts)
    while ts and ts[0] in ("+", "-"):
        other, ts = _product(ts[1:])
        if other != dim:
            raise UnknownSymbol("terms of a sum differ")
    return dim, ts


def _product(ts: list[str]) -> tuple[tuple[int, ...], list[str]]:
    dim, ts = _power(ts)
    while ts and ts[0] in ("*", "/"):
        sign = 1 if ts[0] == "*" else -1
        other, ts = _power(ts[1:])
        dim = tuple(a + sign * b for a, b in zip(dim, other))
    return dim, ts


def _power(ts: list[str]) -> tuple[tuple[int, ...], list[str]]:
    head, ts = ts[0], ts[1:]
    if head == "(":
        dim, ts = _sum(ts)
        if not ts or ts[0] != ")":
            raise UnknownSymbol("a bracket is open")
        ts = ts[1:]
    elif head[0].isdigit() or head in NUMBERS:
        dim = (0,) * 5
    elif head in SYMBOLS:
        dim = SYMBOLS[head]
    else:
        raise UnknownSymbol(head)
    if ts and ts[0] == "^":
        sign, ts = (-1, ts[2:]) if ts[1] == "-" else (1, ts[1:])
        if not ts[0].isdigit():
            raise UnknownSymbol("an exponent isn't a whole number")
        dim, ts = tuple(sign * int(ts[0]) * d for d in dim), ts[1:]
    return dim, ts


def check(equation: str) -> str:
    """``consistent``, ``mismatch`` or ``dimension_unknown`` for ``lhs = rhs``."""
    sides = equation.split("=")
    if len(sides) != 2:
        return "dimension_unknown"
    a, b = map(dimension, sides)
    return "dimension_unknown" if a is None or b is None else "consistent" if a == b else "mismatch"
