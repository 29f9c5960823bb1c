"""Queries of research cycles: roll-ups, decisions from evidence, benchmarks, briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataclaim.functions import lexicons as lx
from strataclaim.functions import sqltext as sq
from strataclaim.functions import text as tx
from strataclaim.operators import graph
from strataclaim.operators.evidence import grounding
from strataclaim.operators.likejoin import like_join
from strataclaim.operators.retrieval import vector_topk
from strataclaim.plans.aggplans import _EVID, _GROUND, _evidence
from strataclaim.plans.catalog import query
from strataclaim.plans.graphplans import _CH, _SIM, _chains, _state, _steps_sql
from strataclaim.plans.joinplans import _DOT, _HOP, _two_hops
from strataclaim.session import cut, table

_STOP = ("the", "and", "of", "in", "a", "to", "for", "with", "on", "by", "is", "that", "how", "we", "from", "at", "as")


@query(f"""WITH n AS (SELECT id, trim(lower(subject), ' ') AS s FROM observations WHERE subject IS NOT NULL),
t AS (SELECT id, s, regexp_extract_all(s, '[a-z0-9]+') AS ts FROM n)
SELECT id, CAST(length(s) >= 3 AND NOT (length(s) > 25 AND contains(s, ':')) AND length(regexp_replace(s, '[^0-9]', '', 'g')) <= 0.3 * length(s) AND len(list_filter(ts, lambda w: list_contains([{", ".join(map(sq.q, _STOP))}], w))) <= 0.6 * len(ts)
 AND len(list_filter(ts, lambda w: length(w) > 2 AND NOT list_contains([{", ".join(map(sq.q, _STOP))}], w))) >= 1 AND NOT (length(s) > 70 AND regexp_matches(s, '[.!?]')) AS BOOLEAN) AS looks_like_concept FROM t""")
def concept_shape(spark: SparkSession, d: str) -> DataFrame:
    """Whether a subject has the shape of a concept's name."""
    s = F.trim(F.lower("subject"))
    ts = F.regexp_extract_all(s, F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*map(F.lit, _STOP))
    n = F.length(s)
    ok = (n >= 3) & ~((n > 25) & s.contains(":")) & (F.length(F.regexp_replace(s, "[^0-9]", "")) <= 0.3 * n) & (F.size(F.filter(ts, lambda w: F.array_contains(stop, w))) <= 0.6 * F.size(ts))
    ok = ok & (F.size(F.filter(ts, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))) >= 1) & ~((n > 70) & s.rlike("[.!?]"))
    return table(spark, d, "observations").where("subject is not null").select("id", ok.alias("looks_like_concept"))


_VERBS = ("reduces", "improves", "increases", "absorbs", "hinders", "prevents", "enables", "weakens", "amplifies", "outweighs")
_TRIPLE = r"^(?:there is evidence that )?([a-z][a-z -]*?) (" + "|".join(_VERBS) + r") ([a-z][a-z -]*?)(?: (?:by|in|at|on|with|under|after)\b.*)?[.]?\z"


@query(f"""WITH b AS (SELECT id, regexp_extract(lower(belief_text), {sq.q(_TRIPLE)}, 1) AS s, regexp_extract(lower(belief_text), {sq.q(_TRIPLE)}, 2) AS r, regexp_extract(lower(belief_text), {sq.q(_TRIPLE)}, 3) AS o FROM beliefs)
SELECT b.id, x.id AS subject_id, b.r AS relation, y.id AS object_id FROM b JOIN concept_cells x ON x.canonical_name = b.s JOIN concept_cells y ON y.canonical_name = b.o WHERE b.s <> b.o""")
def belief_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples of belief sentences by pattern, both ends found among the concepts."""
    t = F.lower("belief_text")
    part = lambda k: F.regexp_extract(t, _TRIPLE, k)
    b = table(spark, d, "beliefs").select("id", part(1).alias("s"), part(2).alias("relation"), part(3).alias("o")).where("s <> o")
    c = table(spark, d, "concept_cells")
    return b.join(c.select(F.col("id").alias("subject_id"), F.col("canonical_name").alias("s")), "s").join(c.select(F.col("id").alias("object_id"), F.col("canonical_name").alias("o")), "o").select("id", "subject_id", "relation", "object_id")


_PERPETUAL = ("perpetual motion", "free energy", "over-unity", "infinite energy", "without limit")


@query(f"""SELECT doc_id, CAST(trim(coalesce(text, ''), ' ') = '' AS BOOLEAN) AS is_empty, {sq.has_any(sq.low("text"), _PERPETUAL)} AS perpetual, CAST(regexp_matches(coalesce(text, ''), '[A-Za-z] = [A-Za-z0-9]') AS BOOLEAN) AS has_equation, CAST({sq.has_any(sq.low("text"), lx.ASSUME_WORDS)} AS BOOLEAN) AS states_assumption FROM documents""")
def sanity_flags(spark: SparkSession, d: str) -> DataFrame:
    """Empty texts, impossible claims, equations and stated assumptions."""
    t, low = F.coalesce("text", F.lit("")), tx.low("text")
    return table(spark, d, "documents").select("doc_id", (F.trim(t) == "").alias("is_empty"), tx.has_any(low, _PERPETUAL).alias("perpetual"), t.rlike("[A-Za-z] = [A-Za-z0-9]").alias("has_equation"), tx.has_any(low, lx.ASSUME_WORDS).alias("states_assumption"))


@query("""WITH s AS (SELECT paper_title, lower(predicate) AS p, chunk_id, id FROM observations WHERE paper_title IS NOT NULL AND chunk_id IS NOT NULL) SELECT paper_title, p AS predicate, min(chunk_id) AS first_chunk, count(*) AS n FROM s GROUP BY 1, 2""")
def claim_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Where each predicate of a paper was first observed."""
    o = table(spark, d, "observations").where("paper_title is not null and chunk_id is not null")
    return o.groupBy("paper_title", F.lower("predicate").alias("predicate")).agg(F.min("chunk_id").cast("long").alias("first_chunk"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS a, e.vec_id AS b, q.label AS la, e.label AS lb, {_DOT} AS score FROM q, embeddings e WHERE e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) AS k FROM s) SELECT a, b, round(score, 5) AS score FROM r WHERE k <= 20 AND score >= 0.2 AND la <> lb""")
def semantic_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Of the twenty nearest of every twentieth vector, those near enough and of another group."""
    e = table(spark, d, "embeddings")
    near = vector_topk(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 21).where("query_id <> id")
    k = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    near = near.withColumn("k", k).where("k <= 20 and score >= 0.2").select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score")
    label = lambda n: e.select(F.col("vec_id").alias(n), F.col("label").alias(f"l_{n}"))
    return near.join(label("a"), "a").join(label("b"), "b").where("l_a <> l_b").select("a", "b", F.round("score", 5).alias("score"))


@query(f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query_id, {_DOT} AS score FROM q, embeddings e WHERE e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS k FROM s WHERE score >= 0.1)
SELECT query_id, round(avg(score), 5) AS support, count(*) AS n FROM r WHERE k <= 8 GROUP BY query_id""")
def floor_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the eight best similarities over a floor."""
    e = table(spark, d, "embeddings")
    near = vector_topk(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 9, 0.1).where("query_id <> id and score >= 0.1")
    k = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return near.withColumn("k", k).where("k <= 8").groupBy("query_id").agg(F.round(F.avg("score"), 5).alias("support"), F.count(F.lit(1)).alias("n"))


@query(_EVID + """, g AS (SELECT claim_id, sum(CASE WHEN polarity = 'support' THEN score ELSE 0 END) AS s, sum(CASE WHEN polarity = 'contradict' THEN score ELSE 0 END) AS c, count(*) FILTER (score >= 0.55) AS strong FROM k GROUP BY claim_id)
SELECT claim_id, round(s / (s + c + 1e-9), 5) AS confidence, strong, CASE WHEN strong >= 2 AND s / (s + c + 1e-9) >= 0.62 THEN 'supported' WHEN strong >= 2 AND s / (s + c + 1e-9) <= 0.38 THEN 'contradicted' ELSE 'inconclusive' END AS verdict FROM g""")
def weighted_support(spark: SparkSession, d: str) -> DataFrame:
    """Share of supporting weight of each query, and what follows from it with enough strong evidence."""
    side = lambda p: F.sum(F.when(F.col("polarity") == p, F.col("score")).otherwise(0.0))
    g = _evidence(spark, d).groupBy("claim_id").agg(side("support").alias("s"), side("contradict").alias("c"), F.count_if(F.col("score") >= 0.55).alias("strong"))
    share = F.col("s") / (F.col("s") + F.col("c") + 1e-9)
    return g.select("claim_id", F.round(share, 5).alias("confidence"), "strong", F.when((F.col("strong") >= 2) & (share >= 0.62), "supported").when((F.col("strong") >= 2) & (share <= 0.38), "contradicted").otherwise("inconclusive").alias("verdict"))


@query(_EVID + """, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY round(overlap, 9) DESC, coalesce(title, '')) AS n FROM k)
SELECT claim_id, round(max(overlap), 6) AS best_overlap, round(avg(score), 6) AS mean_score, count(*) AS n FROM r WHERE n <= 5 GROUP BY claim_id""")
def proposal_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The best and the mean of the five most overlapping pieces of evidence."""
    n = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc(F.round("overlap", 9)), F.coalesce("title", F.lit(""))))
    return _evidence(spark, d).withColumn("n", n).where("n <= 5").groupBy("claim_id").agg(F.round(F.max("overlap"), 6).alias("best_overlap"), F.round(F.avg("score"), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))


@query(_GROUND + """ SELECT claim_id, CASE WHEN c >= 3 THEN 'mixed' WHEN s >= 4 AND c <= 1 THEN 'strong' WHEN s >= 3 AND c <= 1 THEN 'moderate' WHEN s >= 2 AND c <= 1 THEN 'moderate_low' WHEN s >= 1 AND c = 0 THEN CASE WHEN round(score, 9) >= 0.65 THEN 'moderate' ELSE 'limited' END WHEN s > 0 AND c > 0 THEN 'mixed' ELSE 'inconclusive' END AS verdict FROM h""")
def research_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Strength of support of each query by its counts for and against."""
    s, c = F.col("supporting"), F.col("contradicting")
    v = F.when(c >= 3, "mixed").when((s >= 4) & (c <= 1), "strong").when((s >= 3) & (c <= 1), "moderate").when((s >= 2) & (c <= 1), "moderate_low").when((s >= 1) & (c == 0), F.when(F.round("score", 9) >= 0.65, "moderate").otherwise("limited")).when((s > 0) & (c > 0), "mixed").otherwise("inconclusive")
    return grounding(_evidence(spark, d)).select("claim_id", v.alias("verdict"))


@query("""WITH v AS (SELECT coalesce(domain, '?') AS domain, upper(trim(coalesce(verdict, ''), ' ')) AS v, query, id FROM training_examples), n AS (SELECT domain, v, count(*) AS n, min(id) AS first_id FROM v GROUP BY 1, 2)
SELECT domain, sum(n)::BIGINT AS n, arg_max(v, (n, -first_id)) AS main_verdict, count(*) AS n_verdicts FROM n GROUP BY domain""")
def report_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of each domain and the most frequent one, the one seen first of a tie."""
    n = table(spark, d, "training_examples").groupBy(F.coalesce("domain", F.lit("?")).alias("domain"), F.upper(F.trim(F.coalesce("verdict", F.lit("")))).alias("v")).agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("first_id"))
    return n.groupBy("domain").agg(F.sum("k").alias("n"), F.max_by("v", F.struct("k", -F.col("first_id"))).alias("main_verdict"), F.count(F.lit(1)).alias("n_verdicts"))


_LABEL = "CASE WHEN step = 0 THEN 'Current state' WHEN mean > 0.68 THEN 'Strong efficiency gains broadly adopted' WHEN mean > 0.60 THEN 'Key methods mature, integration challenges emerge' WHEN mean > 0.52 THEN 'Early adoption, research competition intensifies' ELSE 'Fragmented landscape, no clear dominant method' END"


@query(_SIM + _steps_sql(8, False) + ", u AS (" + " UNION ALL ".join(f"SELECT {k} AS step, round(avg(belief), 5) AS mean, count(*) FILTER (belief > 0.72) AS high FROM b{k}" for k in range(9)) + f") SELECT step, (step * 0.5)::DOUBLE AS year_offset, mean, high, {_LABEL} AS label FROM u")
def trajectory(spark: SparkSession, d: str) -> DataFrame:
    """Mean belief, the number of high ones and the state of the field after each of eight steps of half a year."""
    b, t = _state(spark, d)
    t = graph.adjacency(t)
    out = None
    for n in range(9):
        row = b.agg(F.round(F.avg("belief"), 5).alias("mean"), F.count_if(F.col("belief") > 0.72).alias("high")).select(F.lit(n).alias("step"), "mean", "high")
        out = row if out is None else out.unionByName(row)
        if n < 8:
            # each state is read twice, so it is kept
            b = cut(graph.step(b, t))
    m = F.col("mean")
    label = F.when(F.col("step") == 0, "Current state").when(m > 0.68, "Strong efficiency gains broadly adopted").when(m > 0.60, "Key methods mature, integration challenges emerge").when(m > 0.52, "Early adoption, research competition intensifies").otherwise("Fragmented landscape, no clear dominant method")
    return out.select("step", (F.col("step") * 0.5).cast("double").alias("year_offset"), "mean", "high", label.alias("label"))


@query(_CH + " SELECT start, max(len(rs))::INT AS longest, round(max(weakest), 6) AS firmest, count(*) AS n, CASE WHEN max(weakest) >= 0.85 AND max(len(rs)) >= 3 THEN 0.8 WHEN max(weakest) >= 0.7 AND max(len(rs)) >= 2 THEN 0.5 ELSE 0.3 END::DOUBLE AS effect, CASE WHEN max(weakest) >= 0.85 AND max(len(rs)) >= 3 THEN 26 WHEN max(weakest) >= 0.7 AND max(len(rs)) >= 2 THEN 52 ELSE 128 END AS sample_size FROM allp GROUP BY start")
def effect_and_sample(spark: SparkSession, d: str) -> DataFrame:
    """Expected effect of a concept from its chains, and the sample a test of it needs."""
    g = _chains(spark, d).groupBy("start").agg(F.max("length").alias("longest"), F.max("weakest").alias("w"), F.count(F.lit(1)).alias("n"))
    big, mid = (F.col("w") >= 0.85) & (F.col("longest") >= 3), (F.col("w") >= 0.7) & (F.col("longest") >= 2)
    return g.select("start", "longest", F.round("w", 6).alias("firmest"), "n", F.when(big, 0.8).when(mid, 0.5).otherwise(0.3).alias("effect"), F.when(big, 26).when(mid, 52).otherwise(128).alias("sample_size"))


@query("SELECT company_id, id, hits FROM (SELECT company_id, id, CAST(contains(lower(text), 'plasticity') AS INT) + CAST(contains(lower(text), 'coating') AS INT) + CAST(contains(lower(text), 'relapse') AS INT) AS hits, row_number() OVER (PARTITION BY company_id ORDER BY CAST(contains(lower(text), 'plasticity') AS INT) + CAST(contains(lower(text), 'coating') AS INT) + CAST(contains(lower(text), 'relapse') AS INT) DESC, id) AS k FROM private_papers WHERE company_id IS NOT NULL AND text IS NOT NULL) WHERE k <= 3 AND hits > 0")
def tenant_search(spark: SparkSession, d: str) -> DataFrame:
    """The three best papers of each tenant for a few words."""
    p = table(spark, d, "private_papers").where("company_id is not null and text is not null").select("company_id", "id", tx.count_of(F.lower("text"), ("plasticity", "coating", "relapse")).alias("hits"))
    k = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("hits"), "id"))
    return p.withColumn("k", k).where("k <= 3 and hits > 0").select("company_id", "id", "hits")


@query("SELECT chunk_id, pos FROM (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS pos FROM (SELECT chunk_id FROM chunks ORDER BY chunk_id DESC LIMIT 100))")
def recent_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest chunks, oldest first."""
    last = table(spark, d, "chunks").select("chunk_id").orderBy(F.desc("chunk_id")).limit(100)
    return last.withColumn("pos", F.row_number().over(Window.orderBy("chunk_id")).cast("long"))


_ENT = ("protein", "gene", "cell", "memory", "plasticity", "quantum", "energy", "field", "polymer", "drug", "patient")


@query(_HOP + f""", q AS (SELECT a, c, max(conf) AS conf FROM h WHERE rn <= 5 GROUP BY a, c) SELECT a, c, round(greatest(0.0, least(1.0, 0.5 + {sq.yes("conf >= 0.8", 0.2)} + {sq.yes(sq.has_any("a", _ENT), 0.1)} + {sq.yes(sq.has_any("c", _ENT), 0.1)} - {sq.yes("length(a) < 4 OR length(c) < 4", 0.4)})), 6) AS quality FROM q""")
def hypothesis_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of two-hop hypotheses by confidence, known entities and noise."""
    q = _two_hops(spark, d).groupBy("a", "c").agg(F.max("conf").alias("conf"))
    score = 0.5 + tx.yes(F.col("conf") >= 0.8, 0.2) + tx.yes(tx.has_any(F.col("a"), _ENT), 0.1) + tx.yes(tx.has_any(F.col("c"), _ENT), 0.1) - tx.yes((F.length("a") < 4) | (F.length("c") < 4), 0.4)
    return q.select("a", "c", F.round(tx.clamp(score, 0.0, 1.0), 6).alias("quality"))


@query("""WITH b AS (SELECT lower(concept_name) AS c, avg(confidence) FILTER (supporting_count > contradicting_count) AS conf, avg(CASE WHEN supporting_count > contradicting_count THEN 1.0 ELSE 0.0 END) AS share FROM beliefs WHERE supporting_count IS NOT NULL AND contradicting_count IS NOT NULL GROUP BY 1),
s AS (SELECT c, round(coalesce(conf * share * 0.9, 0.3) + 1e-9, 4) AS conf FROM b) SELECT c AS concept, conf AS confidence, CASE WHEN conf >= 0.75 THEN 'high' WHEN conf >= 0.55 THEN 'moderate' WHEN conf >= 0.35 THEN 'low' ELSE 'insufficient' END AS recommendation FROM s""")
def world_simulation(spark: SparkSession, d: str) -> DataFrame:
    """What the beliefs on a concept recommend, by their confidence and agreement."""
    wins = F.col("supporting_count") > F.col("contradicting_count")
    b = table(spark, d, "beliefs").where("supporting_count is not null and contradicting_count is not null").groupBy(F.lower("concept_name").alias("concept")).agg(F.avg(F.when(wins, F.col("confidence"))).alias("conf"), F.avg(wins.cast("double")).alias("share"))
    c = F.round(F.coalesce(F.col("conf") * F.col("share") * 0.9, F.lit(0.3)) + 1e-9, 4)
    return b.select("concept", c.alias("confidence"), F.when(c >= 0.75, "high").when(c >= 0.55, "moderate").when(c >= 0.35, "low").otherwise("insufficient").alias("recommendation"))


@query("""WITH k AS (SELECT lower(concept_name) AS c, count(*) AS n FROM beliefs WHERE contradicting_count > 0 GROUP BY 1) SELECT r.id, round(0.6 * (1 - 2 * abs(r.confidence - 0.5)) + least(0.4, 0.1 * coalesce(k.n, 0)), 6) AS gain FROM causal_relations r LEFT JOIN k ON k.c = lower(r.source_concept) WHERE r.confidence IS NOT NULL""")
def information_gain(spark: SparkSession, d: str) -> DataFrame:
    """How much a test of a relation would tell: uncertainty and contested beliefs around it."""
    k = table(spark, d, "beliefs").where("contradicting_count > 0").groupBy(F.lower("concept_name").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    r = table(spark, d, "causal_relations").where("confidence is not null")
    gain = 0.6 * (1 - 2 * F.abs(F.col("confidence") - 0.5)) + F.least(F.lit(0.4), 0.1 * F.coalesce("n", F.lit(0)))
    return r.join(k, F.lower(r.source_concept) == k.c, "left").select("id", F.round(gain, 6).alias("gain"))


@query("""SELECT id, CASE WHEN s < t THEN s ELSE t END AS concept_a, CASE WHEN s < t THEN t ELSE s END AS concept_b FROM (SELECT id, lower(source_concept) AS s, lower(target_concept) AS t FROM causal_relations WHERE lower(relation_type) IN ('analogous_to', 'shares_mechanism') AND confidence >= 0.7)""")
def analogies(spark: SparkSession, d: str) -> DataFrame:
    """Confident analogies, with their concepts in order."""
    r = table(spark, d, "causal_relations").where(F.lower("relation_type").isin("analogous_to", "shares_mechanism") & (F.col("confidence") >= 0.7))
    s, t = F.lower("source_concept"), F.lower("target_concept")
    return r.select("id", F.least(s, t).alias("concept_a"), F.greatest(s, t).alias("concept_b"))


@query("""SELECT 'observations' AS tab, count(*) AS n, count(DISTINCT domain) AS domains FROM observations UNION ALL SELECT 'beliefs', count(*), count(DISTINCT domain) FROM beliefs UNION ALL SELECT 'concept_cells', count(*), count(DISTINCT domain) FROM concept_cells UNION ALL SELECT 'chunks', count(*), count(DISTINCT domain) FROM chunks""")
def world_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows and domains of the main tables."""
    one = lambda n: table(spark, d, n).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("domain").alias("domains")).select(F.lit(n).alias("tab"), "n", "domains")
    return one("observations").unionByName(one("beliefs")).unionByName(one("concept_cells")).unionByName(one("chunks"))


@query("""SELECT 'belief' AS kind, id, k FROM (SELECT id, row_number() OVER (ORDER BY coalesce(confidence, 0) DESC, id) AS k FROM beliefs) WHERE k <= 5 UNION ALL SELECT 'relation', id, k FROM (SELECT id, row_number() OVER (ORDER BY coalesce(confidence, 0) DESC, id) AS k FROM causal_relations) WHERE k <= 5 UNION ALL SELECT 'concept', id, k FROM (SELECT id, row_number() OVER (ORDER BY coalesce(evidence_count, 0) DESC, id) AS k FROM concept_cells) WHERE k <= 5""")
def morning_brief(spark: SparkSession, d: str) -> DataFrame:
    """The strongest five beliefs, relations and concepts."""

    def top(name: str, kind: str, by: str) -> DataFrame:
        rows = table(spark, d, name).select("id", F.coalesce(by, F.lit(0)).alias("v")).orderBy(F.desc("v"), "id").limit(5)
        return rows.select(F.lit(kind).alias("kind"), "id", F.row_number().over(Window.orderBy(F.desc("v"), "id")).cast("long").alias("k"))

    return top("beliefs", "belief", "confidence").unionByName(top("causal_relations", "relation", "confidence")).unionByName(top("concept_cells", "concept", "evidence_count"))


@query("""SELECT c.id, coalesce(b.n, 0) AS beliefs, coalesce(o.n, 0) AS observations, coalesce(r.n, 0) AS relations FROM concept_cells c LEFT JOIN (SELECT lower(concept_name) AS k, count(*) AS n FROM beliefs GROUP BY 1) b ON b.k = c.canonical_name LEFT JOIN (SELECT subject AS k, count(*) AS n FROM observations GROUP BY 1) o ON o.k = c.canonical_name LEFT JOIN (SELECT source_concept AS k, count(*) AS n FROM causal_relations GROUP BY 1) r ON r.k = c.canonical_name""")
def concept_detail(spark: SparkSession, d: str) -> DataFrame:
    """How much is known of each concept."""
    n = lambda name, key, out: table(spark, d, name).groupBy(key.alias("canonical_name")).agg(F.count(F.lit(1)).alias(out))
    c = table(spark, d, "concept_cells").select("id", "canonical_name")
    c = c.join(n("beliefs", F.lower("concept_name"), "beliefs"), "canonical_name", "left").join(n("observations", F.col("subject"), "observations"), "canonical_name", "left").join(n("causal_relations", F.col("source_concept"), "relations"), "canonical_name", "left")
    return c.select("id", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("beliefs", "observations", "relations")))


@query("""WITH h AS (SELECT t.id, c.id AS concept_id, strpos(lower(t.query), c.canonical_name) AS p FROM training_examples t JOIN concept_cells c ON lower(t.query) LIKE '%' || c.canonical_name || '%'), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, concept_id) AS k FROM h) SELECT id, concept_id, k FROM r WHERE k <= 5""")
def focus_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Concepts named in a query, in order, five at most."""
    c = table(spark, d, "concept_cells").select(F.col("id").alias("concept_id"), F.col("canonical_name").alias("name"))
    h = like_join(c, "name", table(spark, d, "training_examples").select("id", "query"), "query").withColumn("p", F.expr("locate(name, lower(query))"))
    return h.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("p", "concept_id")).cast("long")).where("k <= 5").select("id", "concept_id", "k")


@query("""WITH m AS (SELECT (min(doc_id) + max(doc_id)) / 2 AS m FROM documents), k AS (SELECT doc_id, md5(lower(trim(text, ' '))) AS k FROM documents WHERE text IS NOT NULL), old AS (SELECT DISTINCT k FROM k, m WHERE doc_id <= m) SELECT min(doc_id) AS doc_id, k AS content FROM k, m WHERE doc_id > m AND k NOT IN (SELECT k FROM old) GROUP BY k""")
def incremental_new(spark: SparkSession, d: str) -> DataFrame:
    """Later documents whose content the earlier half doesn't have, one of each content."""
    docs = table(spark, d, "documents")
    # half of all ids, by two extremes instead of a median over every id
    edge = docs.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("m"))
    k = docs.where("text is not null").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("content")).join(F.broadcast(edge), F.lit(True))
    old = k.where("doc_id <= m").select("content").distinct()
    return k.where("doc_id > m").join(old, "content", "left_anti").groupBy("content").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content")
