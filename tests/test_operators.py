"""Operators on small inputs with known results, against brute force, and on odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from strataclaim.functions import dimensions, hooks
from strataclaim.operators import drift, graph, noise
from strataclaim.operators.evidence import belief_confidence, lifecycle
from strataclaim.operators.likejoin import like_join
from strataclaim.operators.retrieval import vector_topk
from strataclaim.session import broadcast_checked, cut, drop_cuts, write_cut

EV = "id long, claim_id long, direction string, weight double, recorded_at timestamp_ntz"


def evidence(spark, rows):
    return spark.createDataFrame([(k, c, d, w, None) for k, (c, d, w) in enumerate(rows)], "id long, claim_id long, direction string, weight double, recorded_at timestamp").withColumn("recorded_at", F.timestamp_seconds("id").cast("timestamp_ntz"))


def test_drift_of_ten_supports(spark):
    last = drift.latest(drift.track(evidence(spark, [(1, "supports", 1.0)] * 10))).withColumn("s", drift.status(F.col("cusum_pos"), F.col("cusum_neg"))).first()
    assert (last.alpha, last.beta, last.n) == (11, 1, 10)
    assert last.belief == pytest.approx(11 / 12) and last.cusum_pos == pytest.approx(0.82, abs=0.01) and last.cusum_neg == 0
    assert last.s == "slight_strengthening"


def test_drift_equals_the_recursion(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), rnd.choice(["supports", "contradicts", "neutral"]), rnd.choice([0.5, 1.0, 2.5])) for _ in range(300)]
    got = {r.claim_id: r for r in drift.latest(drift.track(evidence(spark, rows))).collect()}
    for c in range(3):
        a, b, pos, neg = 1.0, 1.0, 0.0, 0.0
        for _, d, w in (r for r in rows if r[0] == c):
            a, b = a + w * (d == "supports"), b + w * (d == "contradicts")
            x = a / (a + b) - 0.75
            pos, neg = max(0.0, pos + x - 0.02), max(0.0, neg - x - 0.02)
        assert (got[c].cusum_pos, got[c].cusum_neg) == (pytest.approx(pos, abs=1e-9), pytest.approx(neg, abs=1e-9))


def test_drift_of_nothing(spark):
    assert drift.latest(drift.track(spark.createDataFrame([], EV))).count() == 0


@pytest.mark.parametrize("counts, expected", [((1, 0), 0.8929), ((0, 1), 0.302), ((0, 0), 0.5)])
def test_belief_confidence(spark, counts, expected):
    got = spark.range(1).select(belief_confidence(F.lit(counts[0]), F.lit(counts[1])).alias("c")).first().c
    assert got == pytest.approx(expected, abs=1e-4)


@pytest.mark.parametrize("e, c, n, state", [(2, 0.9, 0, "candidate"), (4, 0.6, 0, "emerging"), (8, 0.8, 0, "established"), (8, 0.8, 2, "contested"), (8, 0.2, 0, "contested")])
def test_lifecycle(spark, e, c, n, state):
    assert spark.range(1).select(lifecycle(F.lit(e), F.lit(c), F.lit(n)).alias("s")).first().s == state


def test_like_join_equals_brute_force(spark):
    patterns = ["cold bolt", "bolt", "a_b", "50%", "", None, "xyz", "COLD"]
    texts = ["cold bolt", "very Cold Bolt here", "axb", "a_b", "50% of", "5 of 50", "", None, "cold bolt"]
    p = spark.createDataFrame([(k, x) for k, x in enumerate(patterns)], "pk int, p string")
    t = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "tk int, t string")
    got = sorted((r.pk, r.tk) for r in like_join(p, "p", t, "t").collect())
    p.createOrReplaceTempView("pp"), t.createOrReplaceTempView("tt")
    want = sorted((r.pk, r.tk) for r in spark.sql("select pk, tk from pp join tt on lower(t) like concat('%', lower(p), '%') where p <> ''").collect())
    assert got == want
    left = {r.pk for r in like_join(p, "p", t, "t", "left_anti").collect()}
    assert left == set(range(len(patterns))) - {a for a, _ in want}


def test_chains_visit_no_node_twice(spark):
    edges = spark.createDataFrame([("a", "causes", "b", 0.9), ("b", "causes", "a", 0.8), ("b", "reduces", "c", 0.7), ("c", "causes", "d", 0.6)], "a string, r string, b string, c double")
    got = {(tuple(r.path), round(r.weakest, 6)) for r in graph.chains(edges, spark.createDataFrame([("a",)], "concept string")).collect()}
    assert got == {(("a", "b"), 0.9), (("a", "b", "c"), 0.7), (("a", "b", "c", "d"), 0.6)}


def test_rollouts_are_the_same_in_any_partitioning(spark):
    b = spark.createDataFrame([("x", 0.9), ("y", 0.5)], "node string, belief double")
    m = spark.createDataFrame([("x", "y", 1, 0.02)], "source string, target string, sign int, strength double")
    one = sorted(map(tuple, graph.rollouts(b, m, 4, 3).collect()))
    two = sorted(map(tuple, graph.rollouts(b.repartition(3), m.repartition(2), 4, 3).collect()))
    assert one == two and len(one) == 8


def test_vector_topk_equals_brute_force(spark):
    rnd = random.Random(5)
    vecs = [(k, [rnd.gauss(0, 1) for _ in range(6)]) for k in range(200)] + [(900, None)]
    df = spark.createDataFrame(vecs, "id long, v array<double>").repartition(5)
    got = {}
    for r in vector_topk(df, "id", "v", df.where("id % 20 = 0"), "id", "v", 5, block=3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    for q, v in vecs[:200:20]:
        want = sorted(((-round(sum(a * b for a, b in zip(v, w)), 9), i) for i, w in vecs if w))[:5]
        if q % 20 == 0:
            assert [got[q][k] for k in range(1, 6)] == [i for _, i in want]


@pytest.mark.parametrize("eq, result", [("F = m*a", "consistent"), ("E = m*c0", "mismatch"), ("E = m*v^2", "consistent"), ("x = ", "dimension_unknown"), ("a = b = c", "dimension_unknown"), ("p = (m*v", "dimension_unknown")])
def test_dimensions(eq, result):
    assert dimensions.check(eq) == result


def test_hooks():
    v = hooks.hashed_vectors(["a b", "", None])
    assert abs((v[0] ** 2).sum() - 1) < 1e-9 and not v[1].any() and not v[2].any()
    assert hooks.rule_polarity("x improves y", "x worsens y")[0] == "CONTRADICTS"
    assert hooks.rule_polarity("x improves y", "x improves y")[0] == "SUPPORTS"
    assert hooks.rule_polarity("x", "something else entirely")[0] == "NEUTRAL"


def test_cuts(spark):
    df = spark.range(10)
    assert cut(df).count() == 10 and write_cut(df).count() == 10
    drop_cuts()
    assert broadcast_checked(df, 5)[1] is False and broadcast_checked(df, 10)[1] is True


@pytest.mark.parametrize("name", ["simulate_rollouts", "compare_rollouts"])
def test_rollout_queries_run_all_simulations(spark, small, monkeypatch, name):
    from strataclaim.plans import catalog

    real, ran = graph.rollouts, []

    def spy(b, t, sims=500, steps=8, **more):
        ran.append((sims, steps))
        return real(b, t, 2, 1, **more)

    monkeypatch.setattr(graph, "rollouts", spy)
    assert catalog.queries()[name](spark, small).count() and set(ran) == {(500, 8)}


def test_array_hash_equals_xxhash64(spark):
    import numpy as np
    import pyarrow as pa

    texts = ["x" * n + c for n in range(70) for c in ("", "y", "\u00e9", "\u4e2d\U0001f600")] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [r.h for r in df.select(F.xxhash64(F.lit(42), F.lit(1), F.lit(7), "t").alias("h")).collect()]
    got = np.zeros(len(texts), np.uint64)
    for n, at, parts in noise.by_length(pa.array(texts)):
        got[at] = noise.hash_text(np.repeat(noise.seeds(42, 1, 7)[:, None], len(at), 1), n, parts)[0]
    assert got.view(np.int64).tolist() == want


def web(spark):
    rnd = random.Random(7)
    nodes = ["".join(rnd.choice("abc \u00df\u4e2d\U0001f600-") for _ in range(n)) + str(n) for n in range(70)]
    b = spark.createDataFrame([(x, rnd.random() if k % 17 else None, rnd.random()) for k, x in enumerate(nodes)], "node string, belief double, raised double")
    edges = [(rnd.choice(nodes), rnd.choice([*nodes, "not there"]), rnd.choice([1, -1, 0]), rnd.random() * 0.1) for _ in range(400)]
    edges += [*edges[:20], (nodes[3], nodes[3], 1, 0.05), (nodes[4], nodes[5], 1, float("nan")), (nodes[4], nodes[6], 1, None)]
    return nodes, b, spark.createDataFrame(edges, "source string, target string, sign int, strength double")


@pytest.mark.parametrize("focused, rows", [(False, 10**6), (True, 10**6), (True, 5)])
def test_rollouts_equal_joined_rollouts(spark, monkeypatch, focused, rows):
    monkeypatch.setattr(graph, "GRAPH_ROWS", rows)
    nodes, b, m = web(spark)
    focus = (nodes[10], nodes[20]) if focused else ()
    got = {(r.sim, r.node): (r.belief, r.raised) for r in graph.rollouts(b, m, 3, 5, focus, also=("raised",)).collect()}
    for k, name in enumerate(("belief", "raised")):
        want = {(r.sim, r.node): r.belief for r in graph.joined_rollouts(b.select("node", F.col(name).alias("belief")), m, 3, 5, focus).collect()}
        assert len(got) == 210 and {x: v[k] for x, v in got.items()} == pytest.approx(want, abs=1e-12)


def test_compare_rollouts_draws_its_noise_once_and_joins_no_step(spark, small, monkeypatch):
    from strataclaim.plans import catalog

    real, ran = graph.rollouts, []

    def spy(*args, **more):
        ran.append(real(*args, **more))
        return ran[-1]

    monkeypatch.setattr(graph, "rollouts", spy)
    catalog.queries()["compare_rollouts"](spark, small)
    assert len(ran) == 1
    plan = ran[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_simulate_rollouts_writes_no_row_of_a_simulation(spark, small, monkeypatch):
    from strataclaim.plans import catalog

    real, rows = graph.cut, []

    def spy(df):
        rows.append(real(df))
        return rows[-1]

    monkeypatch.setattr(graph, "cut", spy)
    df = catalog.queries()["simulate_rollouts"](spark, small)
    assert df.count() == 127 and [x.columns for x in rows] == [["source", "target", "sign", "strength"]]
