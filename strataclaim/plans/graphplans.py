"""Queries of the graph: edges, chains, transitivity, propagation, simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataclaim.functions import lexicons as lx
from strataclaim.functions import sqltext as sq
from strataclaim.operators import graph
from strataclaim.plans.catalog import query
from strataclaim.session import cut, table

_E = "e AS (SELECT lower(source_concept) AS a, lower(relation_type) AS r, lower(target_concept) AS b, max(confidence) AS c FROM causal_relations WHERE confidence IS NOT NULL GROUP BY ALL)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "causal_relations").where("confidence is not null")
    return r.groupBy(F.lower("source_concept").alias("a"), F.lower("relation_type").alias("r"), F.lower("target_concept").alias("b")).agg(F.max("confidence").alias("c"))


@query(f"WITH {_E} SELECT a, r, b FROM e UNION SELECT b, r, a FROM e WHERE r IN ('analogous_to', 'shares_mechanism')")
def symmetric_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with the reverse of symmetric ones, each once."""
    e = _edges(spark, d).select("a", "r", "b")
    return e.union(e.where(F.col("r").isin("analogous_to", "shares_mechanism")).select("b", "r", "a")).distinct()


@query(f"WITH {_E} SELECT a AS concept, count(DISTINCT b) AS out_degree, string_agg(DISTINCT r, '|' ORDER BY r) AS relations FROM e GROUP BY a")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours and relations of each concept."""
    return _edges(spark, d).groupBy(F.col("a").alias("concept")).agg(F.count_distinct("b").alias("out_degree"), F.array_join(F.array_sort(F.collect_set("r")), "|").alias("relations"))


@query(f"WITH {_E} SELECT x.a AS a, x.b AS via, y.b AS c, x.r AS r1, y.r AS r2 FROM e x JOIN e y ON x.b = y.a WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM e z WHERE z.a = x.a AND z.r = y.r AND z.b = y.b)")
def transitive_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Edges that two others in a row propose and that don't exist yet."""
    e = _edges(spark, d)
    x, y = e.select("a", F.col("r").alias("r1"), F.col("b").alias("via")), e.select(F.col("a").alias("via"), F.col("r").alias("r2"), F.col("b").alias("c"))
    known = e.select("a", F.col("r").alias("r2"), F.col("b").alias("c"))
    return x.join(y, "via").where("a <> c").join(known, ["a", "r2", "c"], "left_anti").select("a", "via", "c", "r1", "r2")


_CH = f"""WITH {_E}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b, r) AS k FROM e) WHERE k <= 5),
s AS (SELECT lower(canonical_name) AS n FROM concept_cells WHERE evidence_count >= 8),
l1 AS (SELECT n AS start, [n, b] AS path, [r] AS rs, least(1.0, c) AS weakest FROM s JOIN f ON f.a = n WHERE b <> n),
l2 AS (SELECT start, list_append(path, b) AS path, list_append(rs, r) AS rs, least(weakest, c) AS weakest FROM l1 JOIN f ON f.a = path[-1] WHERE NOT list_contains(path, b)),
l3 AS (SELECT start, list_append(path, b) AS path, list_append(rs, r) AS rs, least(weakest, c) AS weakest FROM l2 JOIN f ON f.a = path[-1] WHERE NOT list_contains(path, b)),
allp AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""


def _chains(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "concept_cells").where("evidence_count >= 8").select(F.lower("canonical_name").alias("concept"))
    return graph.chains(_edges(spark, d), starts)


@query(_CH + " SELECT array_to_string(path, ' > ') AS chain, array_to_string(rs, '|') AS relations, round(weakest, 6) AS weakest, len(rs)::INT AS length FROM allp")
def mechanism_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of up to three causal edges from well-founded concepts, with their weakest link."""
    return _chains(spark, d).select(F.array_join("path", " > ").alias("chain"), F.array_join("relations", "|").alias("relations"), F.round("weakest", 6).alias("weakest"), "length")


@query(_CH + """, k AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(rs) DESC, round(weakest, 9) DESC, array_to_string(path, ' > '), array_to_string(rs, '|')) AS rn FROM allp)
SELECT start, rn, array_to_string(path, ' > ') AS chain, round(weakest, 6) AS weakest FROM k WHERE rn <= 3""")
def best_mechanisms(spark: SparkSession, d: str) -> DataFrame:
    """The three longest chains of each concept, the firmer first."""
    from pyspark.sql import Window

    c = _chains(spark, d).withColumn("chain", F.array_join("path", " > "))
    rn = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("length"), F.desc(F.round("weakest", 9)), "chain", F.array_join("relations", "|"))).cast("long")
    return c.withColumn("rn", rn).where("rn <= 3").select("start", "rn", "chain", F.round("weakest", 6).alias("weakest"))


@query(_CH + """, p AS (SELECT start, path[-1] AS node, min(len(rs)) AS depth FROM allp GROUP BY 1, 2) SELECT start, depth::INT AS depth, count(*) AS n FROM p GROUP BY 1, 2""")
def reachable(spark: SparkSession, d: str) -> DataFrame:
    """How many concepts are first reached at each depth."""
    p = _chains(spark, d).groupBy("start", F.element_at("path", -1).alias("node")).agg(F.min("length").alias("depth"))
    return p.groupBy("start", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(_CH + """ SELECT start AS concept, count(*) FILTER (rs[1] IN ('causes', 'enables', 'increases', 'improves', 'accelerates', 'supports')) AS promotes, count(*) FILTER (rs[1] IN ('prevents', 'reduces', 'inhibits', 'worsens')) AS limits, count(*) FILTER (rs[1] IN ('requires', 'depends_on')) AS needs FROM l1 GROUP BY start""")
def explain_concept(spark: SparkSession, d: str) -> DataFrame:
    """What a concept promotes, limits and needs directly."""
    r = F.get("relations", 0)
    c = _chains(spark, d).where("length = 1").groupBy(F.col("start").alias("concept"))
    return c.agg(F.count_if(r.isin("causes", "enables", "increases", "improves", "accelerates", "supports")).alias("promotes"), F.count_if(r.isin("prevents", "reduces", "inhibits", "worsens")).alias("limits"), F.count_if(r.isin("requires", "depends_on")).alias("needs"))


_SIGN = "CASE r " + " ".join(f"WHEN {sq.q(k)} THEN {s}" for k, (s, _) in lx.RELATION_EFFECTS.items()) + " ELSE 0 END"
_MOST = "CASE r " + " ".join(f"WHEN {sq.q(k)} THEN {m}" for k, (_, m) in lx.RELATION_EFFECTS.items()) + " ELSE 0.15 END"
_SIM = f"""WITH {_E}, ends AS (SELECT a AS node, 0.05 AS w FROM e UNION ALL SELECT b, 0.03 FROM e), b0 AS (SELECT node, least(1.0, 0.5 + sum(w)) AS belief FROM ends GROUP BY node),
t AS (SELECT a AS source, b AS target, {_SIGN} AS sign, round(c * CAST({_MOST} AS DOUBLE) * 0.04, 5) AS strength FROM e)"""
_FOCUS = ("dopaminergic plasticity", "glacial runoff")
_FOCUS_SQL = "(" + ", ".join(map(sq.q, _FOCUS)) + ")"


def _steps_sql(n: int, focus: bool) -> str:
    s = f"CASE WHEN t.source IN {_FOCUS_SQL} OR t.target IN {_FOCUS_SQL} THEN least(t.strength * 2.5, 0.12) ELSE t.strength END" if focus else "t.strength"
    return "".join(
        f", p{k} AS (SELECT t.target AS node, sum(t.sign * abs(b.belief - 0.5) * 2.0 * ({s})) AS push FROM b{k - 1} b JOIN t ON t.source = b.node GROUP BY 1), b{k} AS (SELECT b.node, greatest(0.0, least(1.0, b.belief + coalesce(p.push, 0) + (0.5 - b.belief) * (1 - 0.96))) AS belief FROM b{k - 1} b LEFT JOIN p{k} p ON p.node = b.node)"
        for k in range(1, n + 1)
    )


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _edges(spark, d)
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0.05).alias("w")), F.struct(F.col("b").alias("node"), F.lit(0.03).alias("w")))).alias("s")).select("s.*")
    beliefs = ends.groupBy("node").agg(F.least(F.lit(1.0), 0.5 + F.sum("w")).alias("belief"))
    return beliefs, graph.transitions(e.select(F.col("a").alias("source"), F.col("r").alias("relation"), F.col("b").alias("target"), F.col("c").alias("weight")))


@query(_SIM + " SELECT node, round(belief, 6) AS belief FROM b0")
def simulation_state(spark: SparkSession, d: str) -> DataFrame:
    """Initial beliefs of nodes from their edges."""
    return _state(spark, d)[0].select("node", F.round("belief", 6).alias("belief"))


@query(_SIM + " SELECT source, target, sign, strength FROM t")
def edge_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Direction and strength of each edge in propagation."""
    return _state(spark, d)[1]


@query(_SIM + _steps_sql(8, False) + " SELECT node, round(belief, 5) AS belief FROM b8")
def propagate(spark: SparkSession, d: str) -> DataFrame:
    """Beliefs after eight steps without noise."""
    b, t = _state(spark, d)
    t = graph.adjacency(t)
    for n in range(8):
        b = graph.step(b, t)
        b = cut(b) if n == 3 else b
    return b.select("node", F.round("belief", 5).alias("belief"))


@query(_SIM + _steps_sql(8, True) + " SELECT node, round(belief, 5) AS belief FROM b8")
def propagate_focused(spark: SparkSession, d: str) -> DataFrame:
    """Beliefs after eight steps in which edges of two nodes are stronger."""
    b, t = _state(spark, d)
    t = graph.adjacency(t)
    for n in range(8):
        b = graph.step(b, t, focus=_FOCUS)
        b = cut(b) if n == 3 else b
    return b.select("node", F.round("belief", 5).alias("belief"))


@query(_SIM + _steps_sql(2, False) + " SELECT round(greatest(0.0, least(1.0, coalesce(avg(belief) FILTER (contains(node, 'plasticity')), 0.5) - 0.4 * coalesce(avg(belief) FILTER (contains(node, 'risk')), 0.5) + 0.3)), 5) AS field_score FROM b2")
def field_score(spark: SparkSession, d: str) -> DataFrame:
    """Mean belief in benefits against that in costs."""
    b, t = _state(spark, d)
    t = graph.adjacency(t)
    for _ in range(2):
        b = graph.step(b, t)
    mean = lambda w: F.coalesce(F.avg(F.when(F.col("node").contains(w), F.col("belief"))), F.lit(0.5))
    return b.agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean("plasticity") - 0.4 * mean("risk") + 0.3)), 5).alias("field_score"))


@query()
def simulate_rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of noisy rollouts by node: mean belief, share over .72, rank by change."""
    b, t = _state(spark, d)
    ends = graph.rollouts(b, t, sims=500).groupBy("node").agg(F.avg("belief").alias("final"), F.avg((F.col("belief") > 0.72).cast("double")).alias("p_high"))
    return ends.join(b, "node").select("node", F.round("final", 6).alias("final"), F.round("p_high", 6).alias("p_high"), F.round(F.col("final") - F.col("belief"), 6).alias("change"))


@query()
def compare_rollouts(spark: SparkSession, d: str) -> DataFrame:
    """What raising the belief in two nodes by .2 changes elsewhere, over the same noise."""
    b, t = _state(spark, d)
    raised = F.when(F.col("node").isin(*_FOCUS), F.least(F.lit(1.0), F.col("belief") + 0.2)).otherwise(F.col("belief"))
    ends = graph.rollouts(b.withColumn("raised", raised), t, sims=500, also=("raised",)).groupBy("node").agg(F.avg("belief").alias("base"), F.avg("raised").alias("raised"))
    return ends.select("node", F.round("base", 6).alias("base"), F.round("raised", 6).alias("raised"), F.when(F.col("raised") - F.col("base") > 0.01, "positive").when(F.col("raised") - F.col("base") < -0.01, "negative").otherwise("neutral").alias("impact"))


@query("""WITH n AS (SELECT id, trim(regexp_replace(regexp_replace(lower(subject), '[-_/]', ' ', 'g'), '[\\s\\x0B]+', ' ', 'g'), ' ') AS k FROM observations WHERE subject IS NOT NULL), g AS (SELECT k, min(id) AS keep_id, count(*) AS n FROM n WHERE length(k) >= 4 AND k NOT LIKE 'the %' GROUP BY k)
SELECT k AS concept, keep_id, n FROM g WHERE n >= 2""")
def merge_identities(spark: SparkSession, d: str) -> DataFrame:
    """Concepts equal after normalising, merged into the first, without artifacts."""
    k = F.trim(F.regexp_replace(F.regexp_replace(F.lower("subject"), "[-_/]", " "), r"\s+", " "))
    g = table(spark, d, "observations").where("subject is not null").select("id", k.alias("concept")).where((F.length("concept") >= 4) & ~F.col("concept").startswith("the "))
    return g.groupBy("concept").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n >= 2")
