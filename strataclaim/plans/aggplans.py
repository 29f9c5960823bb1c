"""Queries of aggregations: counts, weighted evidence, beliefs, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataclaim.functions import lexicons as lx
from strataclaim.functions import sqltext as sq
from strataclaim.functions import text as tx
from strataclaim.operators.evidence import belief_confidence, grounding, lifecycle, verdict
from strataclaim.plans.catalog import query
from strataclaim.plans.textplans import BELIEFS_SQL, beliefs_of
from strataclaim.session import table


@query("SELECT subject, count(*) AS n, round(avg(confidence), 6) AS confidence FROM observations WHERE subject IS NOT NULL GROUP BY subject HAVING count(*) >= 3 ORDER BY n DESC, subject LIMIT 100")
def top_subjects(spark: SparkSession, d: str) -> DataFrame:
    """The hundred most observed subjects."""
    g = table(spark, d, "observations").where("subject is not null").groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return g.where("n >= 3").orderBy(F.desc("n"), "subject").limit(100)


@query("SELECT lower(concept_name) AS concept, count(*) AS n, sum(supporting_count)::BIGINT AS supporting, sum(contradicting_count)::BIGINT AS contradicting, round(avg(confidence), 6) AS confidence FROM beliefs GROUP BY 1")
def belief_summary(spark: SparkSession, d: str) -> DataFrame:
    """Beliefs of each concept."""
    return table(spark, d, "beliefs").groupBy(F.lower("concept_name").alias("concept")).agg(F.count(F.lit(1)).alias("n"), F.sum("supporting_count").alias("supporting"), F.sum("contradicting_count").alias("contradicting"), F.round(F.avg("confidence"), 6).alias("confidence"))


_LIFE = "CASE WHEN evidence_count < 3 THEN 'candidate' WHEN evidence_count < 6 AND contra = 0 THEN 'emerging' WHEN evidence_count >= 6 AND confidence_score >= 0.75 AND contra = 0 THEN 'established' WHEN contra >= 2 OR confidence_score < 0.5 THEN 'contested' ELSE 'emerging' END"


@query(f"""WITH k AS (SELECT lower(concept_name) AS c, sum(contradicting_count) AS contra FROM beliefs GROUP BY 1),
s AS (SELECT evidence_count, confidence_score, {_LIFE} AS state FROM (SELECT c.*, coalesce(k.contra, 0) AS contra FROM concept_cells c LEFT JOIN k ON lower(c.canonical_name) = k.c))
SELECT state, count(*) AS n, round(avg(confidence_score), 6) AS confidence, round(avg(evidence_count), 6) AS evidence FROM s GROUP BY state""")
def lifecycle_summary(spark: SparkSession, d: str) -> DataFrame:
    """Concepts by stage, from evidence, confidence and contradictions."""
    k = table(spark, d, "beliefs").groupBy(F.lower("concept_name").alias("c")).agg(F.sum("contradicting_count").alias("contra"))
    cells = table(spark, d, "concept_cells")
    s = cells.join(k, F.lower(cells.canonical_name) == k.c, "left").withColumn("state", lifecycle(F.col("evidence_count"), F.col("confidence_score"), F.coalesce("contra", F.lit(0))))
    return s.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence_score"), 6).alias("confidence"), F.round(F.avg("evidence_count"), 6).alias("evidence"))


@query("SELECT lower(relation_type) AS relation, count(*) AS n, count(DISTINCT source_concept) AS n_sources FROM causal_relations GROUP BY 1")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Edges and distinct sources by relation."""
    return table(spark, d, "causal_relations").groupBy(F.lower("relation_type").alias("relation")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_concept").alias("n_sources"))


_CONF = "CASE WHEN s + c = 0 THEN 0.5 ELSE least(0.95, 0.3 + 0.65 * (s / (s + c + 0.1)) + least(0.1, 0.002 * (s + c))) END"


@query(f"""WITH b AS ({BELIEFS_SQL}), g AS (SELECT lower(belief) AS belief, lower(concept) AS concept, sum(CASE WHEN obs_type = 'supports' THEN 1 ELSE 0 END) AS s, sum(CASE WHEN obs_type = 'contradicts' THEN 1 ELSE 0 END) AS c FROM b GROUP BY 1, 2)
SELECT belief, concept, s::BIGINT AS supporting, c::BIGINT AS contradicting, round({_CONF}, 6) AS confidence FROM g""")
def accumulate_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """Beliefs accumulated from all observations, with confidence from their counts."""
    b = beliefs_of(table(spark, d, "observations")).groupBy(F.lower("belief").alias("belief"), F.lower("concept").alias("concept"))
    g = b.agg(F.count_if(F.col("obs_type") == "supports").alias("supporting"), F.count_if(F.col("obs_type") == "contradicts").alias("contradicting"))
    return g.withColumn("confidence", F.round(belief_confidence(F.col("supporting"), F.col("contradicting")), 6))


@query(f"""SELECT id, round(CASE WHEN s + c + r + w + n = 0 THEN 0.5 ELSE least(0.95, 0.3 + 0.65 * ((s + 0.7 * r) / (s + 0.7 * r + c + 0.3 * w + 0.1)) + least(0.1, 0.002 * (s + c + r + w + n))) END, 6) AS confidence
FROM (SELECT id, coalesce(supporting_count, 0) AS s, coalesce(contradicting_count, 0) AS c, coalesce(refining_count, 0) AS r, coalesce(narrowing_count, 0) AS w, coalesce(neutral_count, 0) AS n FROM beliefs)""")
def recompute_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of stored beliefs from their five counts."""
    n = [F.coalesce(f"{k}_count", F.lit(0)) for k in ("supporting", "contradicting", "refining", "narrowing", "neutral")]
    return table(spark, d, "beliefs").select("id", F.round(belief_confidence(*n), 6).alias("confidence"))


_EVID = f"""WITH m AS (SELECT id AS claim_id, list_distinct(list_filter(string_split(trim(regexp_replace(replace(lower(query), '-', ' '), '[\\s\\x0B]+', ' ', 'g'), ' '), ' '), lambda w: length(w) > 2)) AS ct, chunks_json FROM training_examples WHERE chunks_json IS NOT NULL),
j AS (SELECT claim_id, ct, unnest(from_json(chunks_json, '[{{"text":"VARCHAR","title":"VARCHAR","domain":"VARCHAR"}}]')) AS c FROM m WHERE json_valid(chunks_json)),
w AS (SELECT claim_id, c, ct, list_distinct(list_filter(string_split(trim(regexp_replace(replace(lower(c.text), '-', ' '), '[\\s\\x0B]+', ' ', 'g'), ' '), ' '), lambda w: length(w) > 2)) AS tt FROM j WHERE trim(coalesce(c.text, '')) <> ''),
o AS (SELECT claim_id, c.title AS title, c.domain AS source, c.text AS text, lower(c.text) AS low, len(list_intersect(ct, tt)) / greatest(1, len(ct)) AS overlap, CASE WHEN len(ct) * len(tt) = 0 THEN 0.0 ELSE len(list_intersect(ct, tt)) / sqrt(len(ct) * len(tt)) END AS sim FROM w),
v AS (SELECT *, {sq.has_any("low", lx.SUPPORT_MARKERS)} AS sup, {sq.has_any("low", lx.CONTRADICT_MARKERS)} AS con FROM o),
e AS (SELECT claim_id, title, source, text, overlap, sim, CASE WHEN overlap >= 0.20 AND sup AND NOT con THEN 'support' WHEN overlap >= 0.20 AND con AND NOT sup THEN 'contradict' WHEN overlap >= 0.30 AND sup AND con THEN 'neutral' WHEN overlap >= 0.25 THEN 'neutral' END AS polarity, least(1.0, greatest(0.0, 0.65 * sim + 0.35 * overlap)) AS score FROM v),
k AS (SELECT * FROM e WHERE polarity IS NOT NULL)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence items of training examples: their chunks, with polarity by markers and overlap.

    Similarity is the dot product of the unit vectors of both texts' words, worked out from their sets.
    """
    rows = table(spark, d, "training_examples").where("chunks_json is not null").select(F.col("id").alias("claim_id"), tx.tokens_over(F.col("query"), 2).alias("ct"), F.explode(F.from_json("chunks_json", "array<struct<text:string,title:string,domain:string>>")).alias("c"))
    rows = rows.where(F.trim(F.coalesce("c.text", F.lit(""))) != "").withColumn("low", F.lower("c.text"))
    rows = rows.withColumn("tt", tx.tokens_over(F.col("c.text"), 2)).withColumn("common", F.size(F.array_intersect("ct", "tt")))
    both = F.size("ct") * F.size("tt")
    rows = rows.withColumn("overlap", F.col("common") / F.greatest(F.lit(1), F.size("ct"))).withColumn("sim", F.when(both == 0, 0.0).otherwise(F.col("common") / F.sqrt(both)))
    sup, con, o = tx.has_any(F.col("low"), lx.SUPPORT_MARKERS), tx.has_any(F.col("low"), lx.CONTRADICT_MARKERS), F.col("overlap")
    polarity = F.when((o >= 0.20) & sup & ~con, "support").when((o >= 0.20) & con & ~sup, "contradict").when((o >= 0.30) & sup & con, "neutral").when(o >= 0.25, "neutral")
    score = tx.clamp(0.65 * F.col("sim") + 0.35 * o, 0.0, 1.0)
    return rows.select("claim_id", F.col("c.title").alias("title"), F.col("c.domain").alias("source"), F.col("c.text").alias("text"), "overlap", "sim", polarity.alias("polarity"), score.alias("score")).where("polarity is not null")


@query(_EVID + " SELECT claim_id, coalesce(title, '') AS title, polarity, round(overlap, 6) AS overlap, round(sim, 6) AS similarity, round(score, 6) AS score FROM k")
def evidence_items(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that bear on a query, with polarity, overlap and score."""
    return _evidence(spark, d).select("claim_id", F.coalesce("title", F.lit("")).alias("title"), "polarity", F.round("overlap", 6).alias("overlap"), F.round("sim", 6).alias("similarity"), F.round("score", 6).alias("score"))


_GROUND = _EVID + """, g AS (SELECT claim_id, count(*) AS n, count(*) FILTER (polarity = 'support') AS s, count(*) FILTER (polarity = 'contradict') AS c, coalesce(avg(score) FILTER (polarity = 'support'), 0.0) AS avg_s, coalesce(avg(score) FILTER (polarity = 'contradict'), 0.0) AS avg_c,
 count(DISTINCT source) FILTER (source <> 'unknown' AND source <> '') AS ns, count(DISTINCT title) FILTER (title <> 'unknown' AND title <> '') AS nt FROM k GROUP BY claim_id),
h AS (SELECT *, 0.5 * (least(1.0, ns / 2.0) + least(1.0, nt / 2.0)) AS diversity, least(1.0, n / 6.0) AS coverage, least(1.0, greatest(0.0, avg_s * s / n - 1.15 * (avg_c * c / n) + 0.20 * 0.5 * (least(1.0, ns / 2.0) + least(1.0, nt / 2.0)) + 0.25 * least(1.0, n / 6.0))) AS score FROM g)"""


@query(_GROUND + " SELECT claim_id, n, s AS supporting, c AS contradicting, round(diversity, 5) AS diversity, round(coverage, 5) AS coverage, round(score, 5) AS score FROM h")
def ground_claims(spark: SparkSession, d: str) -> DataFrame:
    """Grounding of each query in its evidence: counts, diversity, coverage, score."""
    g = grounding(_evidence(spark, d))
    return g.select("claim_id", "n", "supporting", "contradicting", *(F.round(c, 5).alias(c) for c in ("diversity", "coverage", "score")))


@query(_GROUND + """, vv AS (SELECT claim_id, round(score, 9) AS sc, s, c, avg_s, avg_c, CASE WHEN n = 0 THEN 'inconclusive' WHEN s - c >= 2 AND round(score, 9) >= 0.55 AND avg_s >= avg_c THEN 'supported' WHEN c - s >= 2 AND avg_c > avg_s THEN 'contradicted' WHEN s > c AND round(score, 9) >= 0.40 THEN 'partially_supported' ELSE 'inconclusive' END AS verdict FROM h)
SELECT claim_id, verdict, round(CASE verdict WHEN 'supported' THEN least(0.95, sc + 0.10) WHEN 'contradicted' THEN least(0.95, greatest(0.35, 0.45 + 0.05 * abs(s - c))) WHEN 'partially_supported' THEN least(0.95, sc) ELSE least(0.75, greatest(0.20, sc)) END, 5) AS confidence FROM vv""")
def claim_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict and confidence of each query from its grounding."""
    g = grounding(_evidence(spark, d)).withColumn("score", F.round("score", 9))
    v, conf = verdict(*(F.col(c) for c in ("n", "supporting", "contradicting", "avg_s", "avg_c", "score")))
    return g.select("claim_id", v.alias("verdict"), F.round(conf, 5).alias("confidence"))


@query("SELECT coalesce(domain, '(none)') AS domain, coalesce(source, '(none)') AS source, count(*) AS n, count(DISTINCT paper_title) AS papers FROM chunks GROUP BY 1, 2")
def chunks_by_domain(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and papers by domain and source."""
    return table(spark, d, "chunks").groupBy(F.coalesce("domain", F.lit("(none)")).alias("domain"), F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("paper_title").alias("papers"))


@query("SELECT coalesce(domain, '*') AS domain, coalesce(v, '*') AS verdict, (grouping(domain) + 2 * grouping(v))::INT AS lvl, count(*) AS n, round(avg(quality_score), 6) AS quality FROM (SELECT coalesce(domain, '?') AS domain, coalesce(upper(trim(verdict)), '?') AS v, quality_score FROM training_examples) GROUP BY CUBE (domain, v)")
def training_stats(spark: SparkSession, d: str) -> DataFrame:
    """Training examples by domain and verdict, with all subtotals."""
    t = table(spark, d, "training_examples").select(F.coalesce("domain", F.lit("?")).alias("domain"), F.coalesce(F.upper(F.trim("verdict")), F.lit("?")).alias("v"), "quality_score")
    g = t.cube("domain", "v").agg((F.grouping("domain").cast("int") + 2 * F.grouping("v").cast("int")).alias("lvl"), F.count(F.lit(1)).alias("n"), F.round(F.avg("quality_score"), 6).alias("quality"))
    return g.select(F.coalesce("domain", F.lit("*")).alias("domain"), F.coalesce("v", F.lit("*")).alias("verdict"), "lvl", "n", "quality")


@query("SELECT coalesce(company_id, '(public)') AS company, (SELECT count(*) FROM private_papers p WHERE p.company_id = o.company_id) AS papers, count(*) AS observations FROM observations o GROUP BY company_id")
def tenant_stats(spark: SparkSession, d: str) -> DataFrame:
    """Papers and observations of each tenant."""
    o = table(spark, d, "observations").groupBy("company_id").agg(F.count(F.lit(1)).alias("observations"))
    p = table(spark, d, "private_papers").groupBy("company_id").agg(F.count(F.lit(1)).alias("papers"))
    return o.join(p, "company_id", "left").select(F.coalesce("company_id", F.lit("(public)")).alias("company"), F.coalesce("papers", F.lit(0)).cast("long").alias("papers"), "observations")


@query("""WITH g AS (SELECT lower(trim(subject)) AS concept, domain, count(*) AS n FROM observations WHERE trim(coalesce(subject, '')) <> '' AND domain IS NOT NULL AND domain NOT IN ('unknown', 'other', 'general', '') GROUP BY 1, 2)
SELECT concept, domain, n FROM g QUALIFY row_number() OVER (PARTITION BY concept ORDER BY n DESC, domain) = 1""")
def concept_domain(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent domain of each concept, without labels that say nothing."""
    g = table(spark, d, "observations").where("trim(coalesce(subject, '')) <> '' and domain is not null and domain not in ('unknown', 'other', 'general', '')").groupBy(F.lower(F.trim("subject")).alias("concept"), "domain").agg(F.count(F.lit(1)).alias("n"))
    best = g.groupBy("concept").agg(F.min(F.struct((-F.col("n")).alias("k"), "domain")).alias("b"))
    return best.select("concept", "b.domain", (-F.col("b.k")).alias("n"))


@query("WITH m(pos, mechanism, a, b) AS (VALUES " + ", ".join(f"({k}, {sq.q(m)}, {sq.q(a)}, {sq.q(b)})" for k, (m, a, b) in enumerate(lx.BRIDGES)) + """),
g AS (SELECT pos, mechanism, a, b, count(*) FILTER (contains(lower(c.text), mechanism) AND (contains(lower(c.text), left(a, 4)) OR contains(lower(c.text), left(b, 4)))) AS bridge, count(*) FILTER (contains(lower(c.text), mechanism) AND c.domain = a) AS na, count(*) FILTER (contains(lower(c.text), mechanism) AND c.domain = b) AS nb FROM m, chunks c GROUP BY ALL),
n AS (SELECT *, round(1 / (1 + bridge / 10.0), 6) AS novelty FROM g) SELECT mechanism, a AS from_domain, b AS to_domain, bridge, novelty, CAST(na > 0 AND nb > 0 AND pos = (SELECT arg_max(pos, (novelty, -pos)) FROM n WHERE na > 0 AND nb > 0) AS BOOLEAN) AS is_best FROM n""")
def bridge_novelty(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks bridge two domains by a mechanism, how new the bridge would be, and the newest with both sides.

    One pass: each row of the fixed list is three conditional counts, so nothing is joined; the first of a tie is best.
    """
    t = F.lower("text")
    counts = []
    for k, (m, a, b) in enumerate(lx.BRIDGES):
        has = t.contains(m)
        counts += [F.count_if(has & (t.contains(a[:4]) | t.contains(b[:4]))).alias(f"n{k}"), F.count_if(has & (F.col("domain") == a)).alias(f"a{k}"), F.count_if(has & (F.col("domain") == b)).alias(f"b{k}")]
    rows = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(m).alias("mechanism"), F.lit(a).alias("from_domain"), F.lit(b).alias("to_domain"), F.col(f"n{k}").alias("bridge"), F.round(1 / (1 + F.col(f"n{k}") / 10.0), 6).alias("novelty"), ((F.col(f"a{k}") > 0) & (F.col(f"b{k}") > 0)).alias("both")) for k, (m, a, b) in enumerate(lx.BRIDGES)))
    one = table(spark, d, "chunks").agg(*counts).select(rows.alias("rows"))
    best = F.array_max(F.transform(F.filter("rows", lambda r: r["both"]), lambda r: F.array(r["novelty"], (-r["pos"]).cast("double"))))
    out = one.select(F.explode("rows").alias("r"), best.alias("best"))
    return out.select("r.mechanism", "r.from_domain", "r.to_domain", "r.bridge", "r.novelty", F.coalesce(-F.get("best", 1) == F.col("r.pos"), F.lit(False)).alias("is_best"))


@query("""WITH e AS (SELECT lower(source_concept) AS c FROM causal_relations UNION ALL SELECT lower(target_concept) FROM causal_relations) SELECT c AS concept, count(*) AS degree FROM e WHERE length(c) > 3 GROUP BY c HAVING count(*) <= 2""")
def under_researched(spark: SparkSession, d: str) -> DataFrame:
    """Concepts with at most two edges."""
    r = table(spark, d, "causal_relations")
    e = r.select(F.explode(F.array(F.lower("source_concept"), F.lower("target_concept"))).alias("concept"))
    return e.where(F.length("concept") > 3).groupBy("concept").agg(F.count(F.lit(1)).alias("degree")).where("degree <= 2")


@query("""SELECT coalesce(upper(replace(trim(verdict), '_', ' ')), '(none)') AS v, count(*) AS n, round(avg(confidence) FILTER (confidence > 0), 6) AS confidence, round(quantile_cont(quality_score, 0.5), 6) AS median_quality FROM training_examples GROUP BY 1""")
def verdict_overview(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts with mean positive confidence and median quality."""
    return table(spark, d, "training_examples").groupBy(F.coalesce(F.upper(F.replace(F.trim("verdict"), F.lit("_"), F.lit(" "))), F.lit("(none)")).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 6).alias("confidence"), F.round(F.percentile("quality_score", 0.5), 6).alias("median_quality"))


@query("SELECT n.n_name AS nation, count(DISTINCT o.o_orderkey) AS orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    """A star join over the fact table: amounts are summed by order before the joins."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    o = items.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = o.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count_distinct("o_orderkey").alias("orders"), F.sum("amount").alias("amount"))
    return c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.sum("orders").alias("orders"), F.round(F.sum("amount"), 2).alias("revenue"))


@query("""WITH x AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT dim, avg(v) AS m, var_pop(v) AS s2 FROM x GROUP BY dim)
SELECT round(avg(s2), 6) AS mean_variance, round(sqrt(sum(m * m)), 6) AS norm_of_mean, count(*) AS dims FROM s""")
def collapse_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Whether embeddings collapse: variance by dimension and the norm of the mean vector."""
    x = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("dim", "v"))
    s = x.groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("m"), F.var_pop(F.col("v").cast("double")).alias("s2"))
    return s.agg(F.round(F.avg("s2"), 6).alias("mean_variance"), F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("norm_of_mean"), F.count(F.lit(1)).alias("dims"))


@query(f"""WITH b AS ({BELIEFS_SQL}), n AS (SELECT lower(concept) AS c, id, CASE WHEN obs_type = 'supports' AND row_number() OVER (PARTITION BY lower(belief), lower(concept) ORDER BY id) = 1 THEN 1 ELSE 0 END AS fresh, CASE WHEN contains(belief, 'does not') THEN 1 ELSE 0 END AS denies FROM b),
w AS (SELECT id, c, denies, sum(fresh) OVER (PARTITION BY c ORDER BY id DESC ROWS UNBOUNDED PRECEDING) - fresh AS later FROM n)
SELECT id, later::BIGINT AS later_support, round(0.05 * later, 6) AS penalty FROM w WHERE denies = 1""")
def denial_penalty(spark: SparkSession, d: str) -> DataFrame:
    """How much later, new supporting beliefs of a concept weaken its denials, without an order of updates."""
    b = beliefs_of(table(spark, d, "observations")).withColumn("c", F.lower("concept"))
    first = F.row_number().over(Window.partitionBy(F.lower("belief"), "c").orderBy("id")) == 1
    n = b.withColumn("fresh", F.when((F.col("obs_type") == "supports") & first, 1).otherwise(0))
    later = F.sum("fresh").over(Window.partitionBy("c").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("fresh")
    return n.withColumn("later_support", later).where(F.contains("belief", F.lit("does not"))).select("id", "later_support", F.round(0.05 * F.col("later_support"), 6).alias("penalty"))
