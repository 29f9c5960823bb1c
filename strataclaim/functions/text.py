"""Column builders of the text operators: matching, counting, splitting, scoring.

Each takes columns and gives a column, so everything stays in generated code on the JVM side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def low(c: Column | str) -> Column:
    """Lower case; a null counts as empty."""
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def has_any(text: Column, words: Iterable[str]) -> Column:
    """Whether a lower-cased text contains any of the words as a substring."""
    return reduce(or_, (text.contains(w) for w in words))


def matches_any(text: Column, patterns: Iterable[str], literals: Iterable[str] | None = None) -> Column:
    """Whether a text matches any of the patterns.

    ``literals`` has, for each pattern, a string that every match contains: a search for bytes that
    spares most texts the pattern.
    """
    if literals is None:
        return reduce(or_, (text.rlike(p) for p in patterns))
    return reduce(or_, (text.contains(w) & text.rlike(p) for p, w in zip(patterns, literals, strict=True)))


def count_of(text: Column, words: Iterable[str]) -> Column:
    """How many of the words a lower-cased text contains."""
    return reduce(add, (text.contains(w).cast("int") for w in words))


def first_alias(text: Column, aliases: Mapping[str, str]) -> Column:
    """The name of the first alias, in order, that a lower-cased text contains."""
    out = None
    for alias, name in aliases.items():
        hit = text.contains(alias)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def best_bucket(text: Column, buckets: Mapping[str, Iterable[str]], default: str) -> Column:
    """The bucket with most words in the text; the earlier one of a tie; the default if none has any."""
    n = len(buckets)
    scored = F.array(*(F.struct(count_of(text, ws).alias("hits"), F.lit(n - k).alias("order"), F.lit(name).alias("name")) for k, (name, ws) in enumerate(buckets.items())))
    return once(F.array_max(scored), lambda best: F.when(best["hits"] > 0, best["name"]).otherwise(default))


def words_over(c: Column, length: int) -> Column:
    """Words, by blanks, longer than ``length`` characters, lower-cased."""
    return F.filter(F.split(F.lower(c), " "), lambda w: F.length(w) > length)


def tokens_over(c: Column, length: int) -> Column:
    """Distinct tokens of a text longer than ``length``; hyphens separate."""
    return F.array_distinct(F.filter(F.split(squeeze(F.regexp_replace(F.lower(c), "-", " ")), " "), lambda w: F.length(w) > length))


def sentences(c: Column) -> Column:
    """Sentences: split after a stop and white space, squeezed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), squeeze), lambda s: s != "")


def word_chunks(c: Column, size: int, step: int) -> Column:
    """Runs of ``size`` words, a new one every ``step`` words."""
    ws = F.filter(F.split(squeeze(c), " "), lambda w: w != "")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(step)), lambda i: F.array_join(F.slice(ws, i + 1, size), " "))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets of tokens, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def clamp(c: Column, low_: float, high: float) -> Column:
    return F.greatest(F.lit(low_), F.least(F.lit(high), c))


def yes(c: Column, weight: float) -> Column:
    """``weight`` where a condition holds, else 0."""
    return F.when(c, F.lit(weight)).otherwise(F.lit(0.0))


_SIDE = r"A-Za-z0-9_\^\*\+\-/\(\)\s"
#: A whole run of letters that sides of an equation may have, with an equals sign in it.
_EQUATION_RUN = rf"(?<![{_SIDE}])[{_SIDE}]++=[{_SIDE}=]*+"


def equations(c: Column, pattern: str) -> Column:
    """``(lhs, rhs)`` of the equations in a text, trimmed.

    The pattern is tried on runs with an equals sign only: on a whole text it would look at the rest of a run
    again from each of its letters.
    """
    runs = F.when(c.contains("="), F.regexp_extract_all(c, F.lit(_EQUATION_RUN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(pattern), F.lit(0))))
    return F.transform(found, lambda m: F.struct(F.trim(F.substring_index(m, "=", 1)).alias("lhs"), F.trim(F.regexp_replace(F.substring_index(m, "=", -1), r"(?s)^\s+(?=.)", "")).alias("rhs")))
