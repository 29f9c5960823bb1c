"""Operators of claims, substring joins and rules on small cases, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strataclaim.functions import lexicons as lx
from strataclaim.functions import text as tx
from strataclaim.operators.likejoin import like_join
from strataclaim.plans.claimplans import claim_domain, claims_of
from strataclaim.plans.textplans import readable
from strataclaim.session import broadcast_checked


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_substring_joins_equal_brute_force(spark, how):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("aabb _%Cé") for _ in range(n))
    patterns = [(k, word(rnd.randrange(9))) for k in range(60)] + [(100, None), (101, ""), (102, "ab_a"), (102, "ab_a"), (103, "aaaaaaaaaaaaaaaaaaaaaaa")]
    texts = [(k, word(rnd.randrange(25))) for k in range(60)] + [(200, None), (201, ""), (202, "ABCA" * 5)]
    p, t = spark.createDataFrame(patterns, "a long, p string"), spark.createDataFrame(texts, "b long, t string")

    def holds(x, y):
        if not x or not y or not x.replace("%", "").replace("_", ""):
            return False
        import re

        return re.search("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in x.lower()), y.lower(), re.S) is not None

    got = sorted((tuple(r) for r in like_join(p, "p", t, "t", how).select(*(("a", "b") if how == "inner" else ("a",))).collect()), key=str)
    if how == "inner":
        want = [(a, b) for a, x in patterns for b, y in texts if holds(x, y)]
    else:
        want = [(a,) for a, x in patterns if any(holds(x, y) for _, y in texts) == (how == "left_semi")]
    assert got == sorted(want, key=str)


def test_claims_of_a_text(spark):
    rows = [
        (1, "Energy is defined as a capacity. We find that E = m * c and that F = m * a = 3."),
        (2, "define Latency: the time of a step. Our results show that the sparse method reduces latency by 12 percent. Our results show that the sparse method reduces latency by 12 percent."),
        (3, "The weather was fine. The attention layer of this model is described in the next chapter in detail."),
        (4, None), (5, ""), (6, " "),
    ]
    c = claims_of(spark.createDataFrame(rows, "id long, body string"), "id", "body")
    got = {(r.id, r.kind, r.no): r.claim for r in c.collect()}
    assert got[1, "equation", 1].endswith("E = m * c and that F") and got[1, "definition", 1].startswith("Energy is defined as a capacity")
    assert got[2, "definition", 1].startswith("Latency is defined as the time") and [k for k in got if k[0] == 2 and k[1] == "statement"] == [(2, "statement", 1)]
    assert got[3, "statement", 1].startswith("The attention layer") and {k[0] for k in got} == {1, 2, 3}


def test_equations_equal_the_pattern(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab1 +(=;.\n") for _ in range(rnd.randrange(40))) for _ in range(300)]
    import re

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string")
    got = {r.id: [tuple(e) for e in r.e] for r in df.select("id", tx.equations(F.col("t"), lx.EQUATION).alias("e")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == [(a.strip(" "), b.strip(" ")) for a, b in re.findall(lx.EQUATION, t)], repr(t)


@pytest.mark.parametrize("text, domain", [("the transformer has energy", "transformer_efficiency"), ("force and mass", "physics"), ("a lemma", "math"), ("force of a lemma", "mixed"), ("nothing", "unknown"), ("force mass energy, one moe", "physics")])
def test_claim_domains(spark, text, domain):
    assert spark.range(1).select(claim_domain(F.lit(text))).first()[0] == domain


def test_readable_relations(spark):
    one = lambda r: spark.range(1).select(readable(F.lit("a"), F.lit(r), F.lit("b"))).first()[0]
    assert one("reduces") == "a reduces b" and one("has_tradeoff") == "a introduces tradeoffs with b" and one("odd") == "a --odd--> b"


def test_broadcasts_are_bounded_by_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert broadcast_checked(df)[1] and not broadcast_checked(df, max_bytes=50_000)[1] and not broadcast_checked(df, 99)[1]
