"""Hooks for models, with deterministic stand-ins that need none.

``embed`` and ``polarity`` take any callable over batches; the defaults are a hashed bag of words and
a rule of negation and opposite words. Both are vectorised over Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataclaim.functions import lexicons as lx

DIM = 256
_WORD = re.compile(r"[a-z0-9]+")
_NEGATION = re.compile("|".join(lx.NEGATIONS))


def hashed_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Signed hashed word counts, of length 1; an empty text has the zero vector."""
    out = np.zeros((len(texts), dim))
    for row, t in zip(out, texts):
        for w in _WORD.findall((t or "").lower()):
            h = zlib.crc32(w.encode())
            row[h % dim] += 1.0 if h >> 31 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def embed(c: Column, model: Callable[[list[str]], np.ndarray] = hashed_vectors) -> Column:
    """Vectors of texts from a model over batches."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(model([t or "" for t in s])))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(c)


def rule_polarity(premise: str, hypothesis: str) -> tuple[str, float]:
    """SUPPORTS, CONTRADICTS or NEUTRAL by shared words, negation and opposite predicates."""
    p, h = (premise or "").lower(), (hypothesis or "").lower()
    a, b = set(_WORD.findall(p)), set(_WORD.findall(h))
    if len(a & b) < 0.3 * max(1, min(len(a), len(b))):
        return "NEUTRAL", 0.5
    opposed = any(x in a and y in b for x, y in lx.OPPOSITE_PREDICATES.items())
    if opposed != (bool(_NEGATION.search(p)) != bool(_NEGATION.search(h))):
        return "CONTRADICTS", 0.75
    return "SUPPORTS", 0.75


def polarity(premise: Column, hypothesis: Column, model: Callable[[str, str], tuple[str, float]] = rule_polarity) -> Column:
    """Struct of label and confidence for pairs of texts."""

    def run(p: pd.Series, h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model(x, y) for x, y in zip(p, h)], columns=["label", "confidence"])

    run.__annotations__ = {"p": pd.Series, "h": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "label string, confidence double")(premise, hypothesis)


def register(spark: SparkSession) -> None:
    """SQL functions of the scalar operators, for ``spark.sql``."""
    for name, args, body in (
        ("squeeze", "t STRING", "trim(regexp_replace(t, '\\\\s+', ' '))"),
        ("dedupe_key", "t STRING", "sha1(trim(regexp_replace(t, '\\\\s+', ' ')))"),
        ("stable_id", "t STRING", "concat('clm_', left(sha1(t), 12))"),
        ("belief_confidence", "s DOUBLE, c DOUBLE", "case when s + c = 0 then 0.5 else least(0.95, 0.3 + 0.65 * (s / (s + c + 0.1)) + least(0.1, 0.002 * (s + c))) end"),
        ("drift_status", "pos DOUBLE, neg DOUBLE", "case when pos > 1.5 then 'strengthening' when neg > 1.5 then 'weakening' when neg > 0.8 then 'slight_weakening' when pos > 0.8 then 'slight_strengthening' else 'stable' end"),
        ("concept_key", "t STRING", "trim(regexp_replace(regexp_replace(lower(trim(t)), '[-_/]', ' '), '\\\\s+', ' '))"),
    ):
        kind = "DOUBLE" if name == "belief_confidence" else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
