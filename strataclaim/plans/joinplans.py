"""Queries of joins, retrieval and named relational look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataclaim.functions import lexicons as lx
from strataclaim.functions import sqltext as sq
from strataclaim.functions import text as tx
from strataclaim.operators.likejoin import like_join
from strataclaim.operators.retrieval import vector_topk
from strataclaim.plans.catalog import query
from strataclaim.session import broadcast_checked, cut, table

_CROSS = """WITH o AS (SELECT DISTINCT lower(subject) AS s, domain FROM observations WHERE length(subject) > 5 AND domain IS NOT NULL AND domain NOT IN ('unknown', 'other', 'general', '')),
r AS (SELECT DISTINCT lower(source_concept) AS a, lower(target_concept) AS b FROM causal_relations WHERE confidence >= 0.85 AND length(source_concept) > 5 AND length(target_concept) > 5 AND relation_type IN ('causes', 'enables', 'prevents', 'reduces', 'increases', 'accelerates'))"""


@query(_CROSS + " SELECT DISTINCT r.a AS concept_a, r.b AS concept_b, o1.domain AS domain_a, o2.domain AS domain_b FROM r JOIN o o1 ON o1.s LIKE '%' || left(r.a, 15) || '%' JOIN o o2 ON o2.s LIKE '%' || left(r.b, 15) || '%' WHERE o1.domain <> o2.domain")
def cross_domain_links(spark: SparkSession, d: str) -> DataFrame:
    """Causal relations whose two concepts are observed in different domains (substring matches)."""
    o = table(spark, d, "observations").where("length(subject) > 5 and domain is not null and domain not in ('unknown', 'other', 'general', '')").select(F.lower("subject").alias("s"), "domain").distinct()
    r = table(spark, d, "causal_relations").where("confidence >= 0.85 and length(source_concept) > 5 and length(target_concept) > 5").where(F.col("relation_type").isin("causes", "enables", "prevents", "reduces", "increases", "accelerates"))
    r = r.select(F.lower("source_concept").alias("a"), F.lower("target_concept").alias("b")).distinct()
    # subjects collapse to (concept prefix, domain) before they meet the relations
    side = lambda c, name: like_join(r.select(c, F.left(c, F.lit(15)).alias("p")).distinct(), "p", o, "s").select(c, F.col("domain").alias(name)).distinct()
    return r.join(side("a", "domain_a"), "a").join(side("b", "domain_b"), "b").where("domain_a <> domain_b").select(F.col("a").alias("concept_a"), F.col("b").alias("concept_b"), "domain_a", "domain_b").distinct()


_HOP = """WITH e AS (SELECT lower(source_concept) AS a, lower(relation_type) AS r, lower(target_concept) AS b, max(confidence) AS c FROM causal_relations WHERE confidence >= 0.6 AND length(source_concept) > 4 AND length(target_concept) > 4 GROUP BY ALL),
h AS (SELECT x.a, x.b, y.b AS c, x.r AS r1, y.r AS r2, (x.c + y.c) / 2 AS conf, row_number() OVER (PARTITION BY x.a, x.r, x.b ORDER BY y.c DESC, y.b, y.r, y.a) AS rn FROM e x JOIN e y ON y.a LIKE '%' || left(x.b, 25) || '%' WHERE x.a <> y.b)"""
_INFER = "CASE WHEN r1 = 'requires' OR r2 = 'requires' THEN 'requires' WHEN r1 IN ('causes', 'enables', 'increases', 'accelerates') AND r2 IN ('causes', 'enables', 'increases', 'accelerates') THEN 'causes' WHEN r1 IN ('causes', 'enables', 'increases', 'accelerates') AND r2 IN ('prevents', 'reduces', 'inhibits') THEN 'reduces' WHEN r1 IN ('prevents', 'reduces', 'inhibits') AND r2 IN ('causes', 'enables', 'increases', 'accelerates') THEN 'prevents' ELSE 'influences' END"


def inferred_relation(r1: str, r2: str) -> F.Column:
    """What two relations in a row amount to."""
    causal, preventive = ("causes", "enables", "increases", "accelerates"), ("prevents", "reduces", "inhibits")
    a, b = F.col(r1), F.col(r2)
    return F.when((a == "requires") | (b == "requires"), "requires").when(a.isin(*causal) & b.isin(*causal), "causes").when(a.isin(*causal) & b.isin(*preventive), "reduces").when(a.isin(*preventive) & b.isin(*causal), "prevents").otherwise("influences")


def _edges(spark: SparkSession, d: str, least: float = 0.6) -> DataFrame:
    r = table(spark, d, "causal_relations").where((F.col("confidence") >= least) & (F.length("source_concept") > 4) & (F.length("target_concept") > 4))
    return r.groupBy(F.lower("source_concept").alias("a"), F.lower("relation_type").alias("r"), F.lower("target_concept").alias("b")).agg(F.max("confidence").alias("c"))


def _two_hops(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    x = e.select(F.col("a").alias("xa"), F.col("r").alias("r1"), F.col("b").alias("xb"), F.col("c").alias("xc"), F.left("b", F.lit(25)).alias("p"))
    h = like_join(x, "p", e.select(F.col("a").alias("ya"), F.col("r").alias("r2"), F.col("b").alias("yb"), F.col("c").alias("yc")), "ya").where("xa <> yb")
    rn = F.row_number().over(Window.partitionBy("xa", "r1", "xb").orderBy(F.desc("yc"), "yb", "r2", "ya"))
    return h.withColumn("rn", rn).where("rn <= 5").select(F.col("xa").alias("a"), F.col("xb").alias("b"), F.col("yb").alias("c"), "r1", "r2", ((F.col("xc") + F.col("yc")) / 2).alias("conf"))


@query(_HOP + f" SELECT a, b, c, r1, r2, {_INFER} AS inferred, round(0.85 * conf, 3) AS confidence FROM h WHERE rn <= 5")
def two_hop_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """Hypotheses a - c from edges a - b and b - c, with the relation they imply; at most five a first edge."""
    return _two_hops(spark, d).select("a", "b", "c", "r1", "r2", inferred_relation("r1", "r2").alias("inferred"), F.round(0.85 * F.col("conf"), 3).alias("confidence"))


@query(_HOP + """, g AS (SELECT DISTINCT a, c FROM h WHERE rn <= 5)
SELECT g.a, g.c FROM g WHERE NOT EXISTS (SELECT 1 FROM causal_relations x WHERE lower(x.source_concept) LIKE '%' || left(g.a, 20) || '%' AND lower(x.target_concept) LIKE '%' || left(g.c, 20) || '%') AND NOT EXISTS (SELECT 1 FROM observations o WHERE lower(o.subject) LIKE '%' || left(g.a, 20) || '%' AND lower(o.object) LIKE '%' || left(g.c, 20) || '%')""")
def untested_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Two-hop pairs that neither a relation nor an observation states yet, by the first 20 letters of both ends.

    What is stated is reduced to its distinct pairs, its first end is met by a substring join and its second by LIKE.
    """
    g = cut(_two_hops(spark, d).select("a", "c").distinct())
    known = table(spark, d, "causal_relations").select(F.lower("source_concept").alias("s"), F.lower("target_concept").alias("t"))
    seen = table(spark, d, "observations").where("subject is not null and object is not null").select(F.lower("subject").alias("s"), F.lower("object").alias("t"))
    firsts = g.select("a", F.left("a", F.lit(20)).alias("p")).distinct()
    hits = like_join(firsts, "p", known.union(seen).distinct(), "s").select("a", "t").join(g, "a").where(F.expr("t like concat('%', left(c, 20), '%')")).select("a", "c").distinct()
    return g.join(hits, ["a", "c"], "left_anti")


_OPP = "CASE lower(predicate) " + " ".join(f"WHEN {sq.q(a)} THEN {sq.q(b)}" for a, b in lx.OPPOSITE_PREDICATES.items()) + " END"


@query(f"""WITH o AS (SELECT lower(subject) AS s, lower(object) AS ob, lower(predicate) AS p, {_OPP} AS opp, count(*) AS n FROM observations WHERE subject IS NOT NULL AND object IS NOT NULL GROUP BY ALL)
SELECT x.s AS subject, x.ob AS object, x.p AS predicate, y.p AS opposite, x.n AS n, y.n AS n_opposite FROM o x JOIN o y ON x.s = y.s AND x.ob = y.ob AND x.opp = y.p""")
def opposite_claims(spark: SparkSession, d: str) -> DataFrame:
    """Observations with opposite predicates between the same subject and object, pre-aggregated."""
    opp = None
    p = F.lower("predicate")
    for a, b in lx.OPPOSITE_PREDICATES.items():
        opp = F.when(p == a, b) if opp is None else opp.when(p == a, b)
    o = table(spark, d, "observations").where("subject is not null and object is not null").groupBy(F.lower("subject").alias("subject"), F.lower("object").alias("object"), p.alias("predicate"), opp.alias("opp")).agg(F.count(F.lit(1)).alias("n"))
    other = o.select("subject", "object", F.col("predicate").alias("opp"), F.col("predicate").alias("opposite"), F.col("n").alias("n_opposite"))
    return o.join(other, ["subject", "object", "opp"]).select("subject", "object", "predicate", "opposite", "n", "n_opposite")


@query("""WITH t AS (SELECT id, unnest(list_distinct(string_split(lower(canonical_name), ' '))) AS w, len(list_distinct(string_split(lower(canonical_name), ' '))) AS k FROM concept_cells),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS common, any_value(x.k) AS ka, any_value(y.k) AS kb FROM t x JOIN t y ON x.w = y.w AND x.id < y.id GROUP BY 1, 2)
SELECT a AS id_a, b AS id_b, round(common / (ka + kb - common), 6) AS similarity FROM p WHERE common / (ka + kb - common) >= 0.3""")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    """Concepts whose names share at least three tenths of their words: a join on words, then counts."""
    ws = F.array_distinct(F.split(F.lower("canonical_name"), " "))
    t = table(spark, d, "concept_cells").select("id", F.explode(ws).alias("w"), F.size(ws).alias("k"))
    x, y = t.select(F.col("id").alias("id_a"), "w", F.col("k").alias("ka")), t.select(F.col("id").alias("id_b"), "w", F.col("k").alias("kb"))
    p = x.join(y, "w").where("id_a < id_b").groupBy("id_a", "id_b", "ka", "kb").agg(F.count(F.lit(1)).alias("n"))
    s = F.col("n") / (F.col("ka") + F.col("kb") - F.col("n"))
    return p.where(s >= 0.3).select("id_a", "id_b", F.round(s, 6).alias("similarity"))


_DOT = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query(f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_DOT} AS score FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 5) AS score, rank::INT AS rank FROM r WHERE rank <= 10""")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every twentieth one, against all."""
    e = table(spark, d, "embeddings")
    return vector_topk(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@query(f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0) SELECT q.vec_id AS query_id, e.vec_id AS id, q.label AS label_a, e.label AS label_b FROM q, embeddings e WHERE e.vec_id <> q.vec_id AND {_DOT} > 0.3""")
def similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All vectors over a similarity to every twentieth one, with the groups of both."""
    e = table(spark, d, "embeddings")
    s = vector_topk(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", None, 0.3).where("score > 0.3 and query_id <> id")
    a, b = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("label_a")), e.select(F.col("vec_id").alias("id"), F.col("label").alias("label_b"))
    return s.select("query_id", "id").join(a, "query_id").join(b, "id").select("query_id", "id", "label_a", "label_b")


_Q = "does dopaminergic plasticity reduce cortical arousal and working memory"
_QW = [w for w in _Q.split() if len(w) > 3]


_QT = [w for w in dict.fromkeys(_Q.split()) if len(w) > 2 and w not in lx.RERANK_STOP_WORDS]
_QV = ", ".join(map(sq.q, dict.fromkeys(w for w in _Q.split() if len(w) > 2)))
_TOKENS = "list_distinct(list_filter(string_split(trim(regexp_replace(replace(lower(text), '-', ' '), '[\\s\\x0B]+', ' ', 'g'), ' '), ' '), lambda w: length(w) > 2))"


@query(f"""WITH v AS (SELECT chunk_id, left(coalesce(paper_title, ''), 60) AS t60, lower(coalesce(text, '')) || ' ' || {sq.low("paper_title")} AS both_, {sq.low("paper_title")} AS ti, {_TOKENS} AS ws FROM chunks),
s AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_intersect([{_QV}], ws)) / sqrt(len([{_QV}]) * len(ws)) END AS sim FROM v), k AS (SELECT * FROM s ORDER BY round(sim, 9) DESC, chunk_id LIMIT 40),
r AS (SELECT chunk_id, t60, (0.6 * sim + 0.4 * {sq.count_of("both_", _QT)} / {len(_QT)}.0) * (CASE WHEN {sq.has_any("ti", [w for w in _QT if len(w) > 4])} THEN 1.5 ELSE 1.0 END) AS score FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY t60 ORDER BY round(score, 9) DESC, chunk_id) AS rn FROM r) SELECT chunk_id, round(score, 6) AS score FROM f WHERE rn = 1 ORDER BY round(score, 9) DESC, chunk_id LIMIT 20""")
def rerank_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Twice as many candidates as wanted by similarity of vectors, reranked with the share of the question's tokens.

    A title with a token of the question counts half more; the best of each title stays, and twenty are given.
    """
    qv = F.array(*map(F.lit, dict.fromkeys(w for w in _Q.split() if len(w) > 2)))
    ti = tx.low("paper_title")
    v = table(spark, d, "chunks").select("chunk_id", F.left(F.coalesce("paper_title", F.lit("")), F.lit(60)).alias("t60"), F.concat(tx.low("text"), F.lit(" "), ti).alias("both"), ti.alias("ti"), tx.tokens_over(F.col("text"), 2).alias("ws"))
    sim = F.when(F.size("ws") == 0, 0.0).otherwise(F.size(F.array_intersect(qv, F.col("ws"))) / F.sqrt(F.size(qv) * F.size("ws")))
    k = v.withColumn("sim", sim).orderBy(F.desc(F.round("sim", 9)), "chunk_id").limit(40)
    boost = F.when(tx.has_any(F.col("ti"), [w for w in _QT if len(w) > 4]), 1.5).otherwise(1.0)
    r = k.select("chunk_id", "t60", F.round((0.6 * F.col("sim") + 0.4 * tx.count_of(F.col("both"), _QT) / float(len(_QT))) * boost, 9).alias("score"))
    best = r.groupBy("t60").agg(F.min(F.struct((-F.col("score")).alias("k"), "chunk_id")).alias("b")).select("b.chunk_id", (-F.col("b.k")).alias("score"))
    return best.orderBy(F.desc("score"), "chunk_id").limit(20).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"""SELECT chunk_id, {sq.count_of("lower(text)", _QW)} AS hits FROM chunks WHERE {sq.count_of("lower(text)", _QW)} > 0 ORDER BY hits DESC, chunk_id LIMIT 30""")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by the number of query words they contain."""
    return table(spark, d, "chunks").select("chunk_id", tx.count_of(F.lower("text"), _QW).alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "chunk_id").limit(30)


@query("""WITH o AS (SELECT DISTINCT paper_title FROM observations WHERE paper_title IS NOT NULL), c AS (SELECT paper_title, min(chunk_id) AS chunk_id, count(*) AS n FROM chunks WHERE paper_title IS NOT NULL AND paper_title <> 'unknown' GROUP BY 1)
SELECT o.paper_title, coalesce(c.chunk_id, -1) AS chunk_id, coalesce(c.n, 0) AS n_chunks FROM o LEFT JOIN c USING (paper_title)""")
def hybrid_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Observed papers with their stored chunks where there are any: an outer join."""
    o = table(spark, d, "observations").where("paper_title is not null").select("paper_title").distinct()
    c = table(spark, d, "chunks").where("paper_title is not null and paper_title <> 'unknown'").groupBy("paper_title").agg(F.min("chunk_id").alias("chunk_id"), F.count(F.lit(1)).alias("n"))
    return o.join(c, "paper_title", "left").select("paper_title", F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_chunks"))


@query("WITH r AS (SELECT unnest([17, 3, 99, 42, 7]) AS chunk_id, unnest([0, 1, 2, 3, 4]) AS pos) SELECT r.pos::INT AS pos, c.chunk_id, left(c.text, 40) AS head FROM r JOIN chunks c USING (chunk_id)")
def fetch_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a list of ids, with their place in the request."""
    wanted = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (17, 3, 99, 42, 7)))).alias("pos", "chunk_id"))
    return F.broadcast(wanted).join(table(spark, d, "chunks"), "chunk_id").select("pos", F.col("chunk_id").cast("long").alias("chunk_id"), F.left("text", F.lit(40)).alias("head"))


@query("SELECT DISTINCT o.id FROM observations o WHERE o.paper_title IN (SELECT title FROM private_papers WHERE title IS NOT NULL)")
def private_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Observations on papers that a tenant has uploaded: a semi join."""
    p = table(spark, d, "private_papers").where("title is not null").select(F.col("title").alias("paper_title"))
    return table(spark, d, "observations").join(p, "paper_title", "left_semi").select("id")


@query("""WITH a AS (SELECT canonical_name, row_number() OVER (ORDER BY coalesce(evidence_count, 0) DESC, id) AS rk FROM concept_cells WHERE lower(canonical_name) LIKE '%plasticity%' OR lower(canonical_name) LIKE '%arousal%'),
c AS (SELECT lower(canonical_name) AS n, rk FROM a WHERE rk <= 5),
b AS (SELECT c.n, b.id, b.supporting_count AS s, row_number() OVER (PARTITION BY c.n ORDER BY coalesce(b.supporting_count, 0) DESC, b.id) AS k FROM c JOIN beliefs b ON lower(b.concept_name) = c.n),
r AS (SELECT c.n, r.id, row_number() OVER (PARTITION BY c.n ORDER BY coalesce(r.confidence, 0) DESC, r.id) AS k FROM c JOIN causal_relations r ON lower(r.source_concept) = c.n)
SELECT n AS concept, 'belief' AS kind, id, k FROM b WHERE k <= 8 UNION ALL SELECT n, 'relation', id, k FROM r WHERE k <= 4""")
def world_context(spark: SparkSession, d: str) -> DataFrame:
    """What is known around a question: its concepts, and their strongest beliefs and relations."""
    n = F.lower("canonical_name")
    c = table(spark, d, "concept_cells").where(n.like("%plasticity%") | n.like("%arousal%")).orderBy(F.desc(F.coalesce("evidence_count", F.lit(0))), "id").limit(5).select(n.alias("concept"))
    top = lambda df, key, order, kind, k: F.broadcast(c).join(df.withColumn("concept", F.lower(key)), "concept").withColumn("k", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc(F.coalesce(order, F.lit(0))), "id")).cast("long")).where(F.col("k") <= k).select("concept", F.lit(kind).alias("kind"), "id", "k")
    return top(table(spark, d, "beliefs"), "concept_name", "supporting_count", "belief", 8).unionByName(top(table(spark, d, "causal_relations"), "source_concept", "confidence", "relation", 4))


@query("SELECT id, predicate, object FROM observations WHERE lower(subject) = 'dopaminergic plasticity' ORDER BY created_at DESC, id DESC LIMIT 50")
def observations_for_subject(spark: SparkSession, d: str) -> DataFrame:
    """The newest observations of a subject."""
    return table(spark, d, "observations").where(F.lower("subject") == "dopaminergic plasticity").orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "predicate", "object")


@query("""SELECT 'weak_concept' AS kind, id, round(0.9 - 0.1 * evidence_count, 6) AS priority FROM concept_cells WHERE evidence_count <= 3 AND length(canonical_name) > 3
UNION ALL SELECT 'contradiction', id, 0.8 FROM beliefs WHERE contradicting_count > 0 AND supporting_count > 0 UNION ALL SELECT 'hypothesis', id, round(confidence, 6) FROM causal_relations WHERE evidence_count = 1 AND confidence IS NOT NULL""")
def reading_queue(spark: SparkSession, d: str) -> DataFrame:
    """What to read next: weak concepts, contradictions and thin relations, with priorities."""
    weak = table(spark, d, "concept_cells").where("evidence_count <= 3 and length(canonical_name) > 3").select(F.lit("weak_concept").alias("kind"), "id", F.round(0.9 - 0.1 * F.col("evidence_count"), 6).alias("priority"))
    contra = table(spark, d, "beliefs").where("contradicting_count > 0 and supporting_count > 0").select(F.lit("contradiction").alias("kind"), "id", F.lit(0.8).alias("priority"))
    thin = table(spark, d, "causal_relations").where("evidence_count = 1 and confidence is not null").select(F.lit("hypothesis").alias("kind"), "id", F.round("confidence", 6).alias("priority"))
    return weak.unionByName(contra).unionByName(thin)


@query("SELECT id, confidence, contradicting_count * supporting_count AS tension FROM beliefs WHERE contradicting_count > 0 ORDER BY tension DESC NULLS LAST, id LIMIT 50")
def contested_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """Beliefs ordered by how much evidence is on both sides."""
    b = table(spark, d, "beliefs").where("contradicting_count > 0").withColumn("tension", F.col("contradicting_count") * F.col("supporting_count"))
    return b.orderBy(F.desc_nulls_last("tension"), "id").limit(50).select("id", "confidence", "tension")


@query("""SELECT id, round(greatest(0.05, least(0.99, 0.4 * confidence + 0.6 * ratio)), 3) AS revised, CASE WHEN 0.4 * confidence + 0.6 * ratio - confidence >= 0.05 THEN 'strengthened' WHEN 0.4 * confidence + 0.6 * ratio - confidence <= -0.05 THEN 'weakened' ELSE 'stable' END AS event
FROM (SELECT id, confidence, supporting_count / (supporting_count + contradicting_count)::DOUBLE AS ratio FROM beliefs WHERE supporting_count + contradicting_count > 0 AND confidence IS NOT NULL)""")
def revise_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """Confidence revised toward the share of supporting evidence, and what that means."""
    b = table(spark, d, "beliefs").where("supporting_count + contradicting_count > 0 and confidence is not null").withColumn("ratio", F.col("supporting_count") / (F.col("supporting_count") + F.col("contradicting_count")))
    new = 0.4 * F.col("confidence") + 0.6 * F.col("ratio")
    return b.select("id", F.round(tx.clamp(new, 0.05, 0.99), 3).alias("revised"), F.when(new - F.col("confidence") >= 0.05, "strengthened").when(new - F.col("confidence") <= -0.05, "weakened").otherwise("stable").alias("event"))


@query("""WITH o AS (SELECT lower(subject) AS s, conditions FROM observations WHERE length(trim(coalesce(conditions, ''))) > 5), k AS (SELECT s, count(DISTINCT lower(trim(conditions))) AS n FROM o GROUP BY s)
SELECT b.id, k.n AS n_conditions FROM beliefs b JOIN k ON k.s = lower(b.concept_name) WHERE b.contradicting_count >= 1 AND b.supporting_count >= 1 AND b.confidence BETWEEN 0.3 AND 0.7 AND k.n >= 2""")
def split_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Contested beliefs whose concept is observed under two conditions or more."""
    k = table(spark, d, "observations").where("length(trim(coalesce(conditions, ''))) > 5").groupBy(F.lower("subject").alias("s")).agg(F.count_distinct(F.lower(F.trim("conditions"))).alias("n_conditions")).where("n_conditions >= 2")
    b = table(spark, d, "beliefs").where("contradicting_count >= 1 and supporting_count >= 1 and confidence between 0.3 and 0.7")
    return b.join(k, F.lower(b.concept_name) == k.s).select("id", "n_conditions")


@query("""WITH r AS (SELECT * FROM observations WHERE id > (SELECT max(id) - 1000 FROM observations)) SELECT b.id, count(*) FILTER (NOT coalesce(r.negated, false)) AS new_support, count(*) FILTER (coalesce(r.negated, false)) AS new_contra FROM beliefs b JOIN r ON lower(r.subject) = lower(b.concept_name) GROUP BY b.id""")
def recent_evidence(spark: SparkSession, d: str) -> DataFrame:
    """New evidence on beliefs among the last thousand observation ids.

    Counted by subject before the join, so a subject seen often meets each belief once.
    """
    o = table(spark, d, "observations")
    last = o.agg((F.max("id") - 1000).alias("edge"))
    neg = F.coalesce("negated", F.lit(False))
    r = o.join(F.broadcast(last), F.col("id") > F.col("edge")).groupBy(F.lower("subject").alias("s")).agg(F.count_if(~neg).alias("new_support"), F.count_if(neg).alias("new_contra"))
    b = table(spark, d, "beliefs")
    return b.join(r, F.lower(b.concept_name) == r.s).select("id", "new_support", "new_contra")


@query("""WITH p AS (SELECT lower(subject) AS s, count(*) AS n, count(DISTINCT domain) AS nd FROM observations WHERE length(subject) > 5 GROUP BY 1 HAVING count(*) >= 8),
t AS (SELECT lower(subject) AS s, domain, count(*) AS n FROM observations WHERE domain IS NOT NULL GROUP BY 1, 2), k AS (SELECT t.domain, t.s, t.n, row_number() OVER (PARTITION BY t.domain ORDER BY t.n DESC, t.s) AS rn FROM t JOIN p USING (s))
SELECT x.s AS concept_a, y.s AS concept_b, x.domain AS domain_a, y.domain AS domain_b FROM k x JOIN k y ON x.domain < y.domain AND x.rn <= 2 AND y.rn <= 2 AND x.s <> y.s WHERE NOT EXISTS (SELECT 1 FROM causal_relations r WHERE lower(r.source_concept) = x.s AND lower(r.target_concept) = y.s)""")
def missing_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of much observed concepts of different domains without a causal relation.

    Two concepts a domain remain before pairs are formed; there are as many rows as domains, times two.
    """
    o = table(spark, d, "observations")
    p = o.where(F.length("subject") > 5).groupBy(F.lower("subject").alias("s")).agg(F.count(F.lit(1)).alias("total")).where("total >= 8").select("s")
    t = o.where("domain is not null").groupBy(F.lower("subject").alias("s"), "domain").agg(F.count(F.lit(1)).alias("n")).join(p, "s")
    k = t.withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "s"))).where("rn <= 2").select("s", "domain")
    pairs = k.select(F.col("s").alias("concept_a"), F.col("domain").alias("domain_a")).join(broadcast_checked(k.select(F.col("s").alias("concept_b"), F.col("domain").alias("domain_b")), 20_000)[0], (F.col("domain_a") < F.col("domain_b")) & (F.col("concept_a") != F.col("concept_b")))
    known = table(spark, d, "causal_relations").select(F.lower("source_concept").alias("concept_a"), F.lower("target_concept").alias("concept_b"))
    return pairs.join(known, ["concept_a", "concept_b"], "left_anti").select("concept_a", "concept_b", "domain_a", "domain_b")


_POS = ("increases", "improves", "enables", "amplifies", "favours")
_NEG = ("no link", "does not", "reduces", "hinders", "blocks")
_CON = ("plasticity", "arousal", "runoff", "attention", "fibrosis", "inflation")


@query(f"""WITH c AS (SELECT chunk_id, paper_title, lower(text) AS t, source FROM chunks WHERE paper_title IS NOT NULL AND paper_title <> 'unknown'),
k AS (SELECT chunk_id, paper_title, {sq.has_any("t", _POS)} AND NOT {sq.has_any("t", _NEG)} AS pos, {sq.has_any("t", _NEG)} AND NOT {sq.has_any("t", _POS)} AS neg, unnest(list_filter([{", ".join(f"CASE WHEN contains(t, {sq.q(x)}) THEN {sq.q(x)} END" for x in _CON)}], lambda v: v IS NOT NULL)) AS concept FROM c),
g AS (SELECT concept, paper_title, bool_or(pos) AS pos, bool_or(neg) AS neg FROM k GROUP BY 1, 2)
SELECT concept, count(*) FILTER (pos) AS n_pos, count(*) FILTER (neg) AS n_neg, count(*) FILTER (pos) * count(*) FILTER (neg) - count(*) FILTER (pos AND neg) AS n_contradictions FROM g GROUP BY concept""")
def contradiction_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of differently titled papers with opposite signals on a concept, counted without pairing them."""
    c = table(spark, d, "chunks").where("paper_title is not null and paper_title <> 'unknown'").withColumn("t", F.lower("text"))
    pos, neg = tx.has_any(F.col("t"), _POS), tx.has_any(F.col("t"), _NEG)
    concepts = F.filter(F.array(*(F.when(F.col("t").contains(x), x) for x in _CON)), lambda v: v.isNotNull())
    k = c.select("paper_title", (pos & ~neg).alias("pos"), (neg & ~pos).alias("neg"), F.explode(concepts).alias("concept"))
    g = k.groupBy("concept", "paper_title").agg(F.bool_or("pos").alias("pos"), F.bool_or("neg").alias("neg"))
    out = g.groupBy("concept").agg(F.count_if("pos").alias("n_pos"), F.count_if("neg").alias("n_neg"), F.count_if(F.col("pos") & F.col("neg")).alias("both"))
    return out.select("concept", "n_pos", "n_neg", (F.col("n_pos") * F.col("n_neg") - F.col("both")).alias("n_contradictions"))


@query(f"""WITH t AS (SELECT chunk_id, lower(text) AS t FROM chunks) SELECT chunk_id, CASE WHEN {sq.has_any("t", lx.TRADEOFF_WORDS)} THEN 'tradeoff' WHEN {sq.has_any("t", lx.HARDWARE_WORDS)} THEN 'hardware_variance' WHEN {sq.has_any("t", lx.DIRECT_WORDS)} AND {sq.has_any("t", lx.METRIC_WORDS)} THEN 'direct' ELSE 'methodological' END AS kind FROM t""")
def contradiction_type(spark: SparkSession, d: str) -> DataFrame:
    """Kind of a contradiction by the words around it, first kind that applies."""
    t = F.lower("text")
    kind = F.when(tx.has_any(t, lx.TRADEOFF_WORDS), "tradeoff").when(tx.has_any(t, lx.HARDWARE_WORDS), "hardware_variance").when(tx.has_any(t, lx.DIRECT_WORDS) & tx.has_any(t, lx.METRIC_WORDS), "direct").otherwise("methodological")
    return table(spark, d, "chunks").select("chunk_id", kind.alias("kind"))


@query("SELECT id, title FROM (SELECT id, coalesce(title, '') AS title, row_number() OVER (PARTITION BY lower(coalesce(title, '')) ORDER BY created_at DESC, id DESC) AS rn FROM private_papers WHERE processed IS NOT TRUE) WHERE rn = 1")
def open_papers(spark: SparkSession, d: str) -> DataFrame:
    """Unprocessed uploads, the newest of each title."""
    p = table(spark, d, "private_papers").where("processed is null or not processed").withColumn("title", F.coalesce("title", F.lit("")))
    last = p.groupBy(F.lower("title").alias("k")).agg(F.max(F.struct("created_at", "id", "title")).alias("s"))
    return last.select("s.id", "s.title")


@query("""WITH a AS (SELECT lower(relation_type) AS r, lower(target_concept) AS t, avg(confidence) AS c FROM causal_relations WHERE lower(source_concept) LIKE '%plasticity%' GROUP BY 1, 2), b AS (SELECT lower(relation_type) AS r, lower(target_concept) AS t, avg(confidence) AS c FROM causal_relations WHERE lower(source_concept) LIKE '%arousal%' GROUP BY 1, 2)
SELECT coalesce(a.r, b.r) AS relation, coalesce(a.t, b.t) AS target, CAST(a.c IS NOT NULL AS BOOLEAN) AS in_a, CAST(b.c IS NOT NULL AS BOOLEAN) AS in_b FROM a FULL JOIN b ON a.r = b.r AND a.t = b.t""")
def compare_methods(spark: SparkSession, d: str) -> DataFrame:
    """What two families of concepts have in common and apart: a full outer join of their edges."""
    r = table(spark, d, "causal_relations")
    side = lambda p, n: r.where(F.lower("source_concept").like(p)).select(F.lower("relation_type").alias("relation"), F.lower("target_concept").alias("target")).distinct().withColumn(n, F.lit(True))
    return side("%plasticity%", "in_a").join(side("%arousal%", "in_b"), ["relation", "target"], "full").select("relation", "target", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))
