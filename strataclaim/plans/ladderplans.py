"""Queries of decisions by rules, of named look-ups, and of the pipelines they make up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataclaim.functions import lexicons as lx
from strataclaim.functions import sqltext as sq
from strataclaim.functions import text as tx
from strataclaim.operators.evidence import grounding, verdict
from strataclaim.operators.likejoin import like_join
from strataclaim.plans.aggplans import _EVID, _GROUND, _LIFE, _evidence
from strataclaim.plans.catalog import query
from strataclaim.plans.claimplans import _setting, _setting_sql
from strataclaim.plans.joinplans import _HOP, _two_hops
from strataclaim.plans.textplans import _METHODS, _METRICS, _kw
from strataclaim.session import broadcast_checked, cut, table

_VERDICTS = _GROUND + """, vv AS (SELECT claim_id, round(score, 9) AS sc, n, s, c, avg_s, avg_c, CASE WHEN n = 0 THEN 'inconclusive' WHEN s - c >= 2 AND round(score, 9) >= 0.55 AND avg_s >= avg_c THEN 'supported' WHEN c - s >= 2 AND avg_c > avg_s THEN 'contradicted' WHEN s > c AND round(score, 9) >= 0.40 THEN 'partially_supported' ELSE 'inconclusive' END AS verdict FROM h),
cv AS (SELECT claim_id, s, c, verdict, CASE verdict WHEN 'supported' THEN least(0.95, sc + 0.10) WHEN 'contradicted' THEN least(0.95, greatest(0.35, 0.45 + 0.05 * abs(s - c))) WHEN 'partially_supported' THEN least(0.95, sc) ELSE least(0.75, greatest(0.20, sc)) END AS confidence FROM vv)"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    g = grounding(_evidence(spark, d)).withColumn("score", F.round("score", 9))
    v, c = verdict(*(F.col(x) for x in ("n", "supporting", "contradicting", "avg_s", "avg_c", "score")))
    return g.select("claim_id", "supporting", "contradicting", v.alias("verdict"), c.alias("confidence"))


# ---------------------------------------------------------------- rules

_RICH = "CASE WHEN c >= 3 THEN 'mixed_evidence' WHEN s >= 4 AND c = 0 THEN 'strong_evidence' WHEN s >= 2 AND c <= 1 THEN 'moderate_evidence' WHEN s >= 1 AND c = 0 THEN CASE WHEN confidence >= 0.65 THEN 'moderate_evidence' ELSE 'limited_evidence' END WHEN s >= 1 AND c >= 1 THEN 'mixed_evidence' WHEN c >= 2 THEN 'mixed_evidence' ELSE 'inconclusive' END"
_FLOOR = "CASE WHEN s >= 4 AND c = 0 THEN 0.78 WHEN s >= 3 AND c <= 1 THEN 0.63 WHEN s >= 2 AND c <= 1 THEN 0.52 WHEN s >= 1 AND c = 0 THEN 0.40 WHEN s >= 1 AND c >= 1 THEN 0.45 WHEN c >= 2 THEN 0.40 ELSE 0.25 END"


@query(_VERDICTS + f", r AS (SELECT claim_id, verdict AS engine, confidence AS own, {_RICH} AS rich, greatest(confidence, {_FLOOR}) AS conf FROM cv) SELECT claim_id, CASE WHEN rich = 'inconclusive' AND engine IN ('supported', 'partially_supported') AND own >= 0.6 THEN 'moderate_evidence' ELSE rich END AS verdict, round(conf, 5) AS confidence FROM r")
def research_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of a question by its counts for and against, with the floors of confidence; the engine's verdict where counts say nothing."""
    v = _verdicts(spark, d)
    s, c, own = F.col("supporting"), F.col("contradicting"), F.col("confidence")
    rich = F.when(c >= 3, "mixed_evidence").when((s >= 4) & (c == 0), "strong_evidence").when((s >= 2) & (c <= 1), "moderate_evidence").when((s >= 1) & (c == 0), F.when(own >= 0.65, "moderate_evidence").otherwise("limited_evidence")).when((s >= 1) | (c >= 2), "mixed_evidence").otherwise("inconclusive")
    floor = F.when((s >= 4) & (c == 0), 0.78).when((s >= 3) & (c <= 1), 0.63).when((s >= 2) & (c <= 1), 0.52).when((s >= 1) & (c == 0), 0.40).when((s >= 1) & (c >= 1), 0.45).when(c >= 2, 0.40).otherwise(0.25)
    final = F.when((rich == "inconclusive") & F.col("verdict").isin("supported", "partially_supported") & (own >= 0.6), "moderate_evidence").otherwise(rich)
    return v.select("claim_id", final.alias("verdict"), F.round(F.greatest(own, floor), 5).alias("confidence"))


_QUALITY = sq.clamp(f"{sq.yes(f'regexp_matches(x, {sq.q("(?i)" + lx.EVIDENCE_NUMERIC)})', 0.45)} + {sq.yes(f'regexp_matches(x, {sq.q("(?i)" + lx.EVIDENCE_METHOD)})', 0.45)} - {sq.yes(f'regexp_matches(x, {sq.q("(?i)" + lx.EVIDENCE_DEFINITION)})', 0.25)} - {sq.yes('length(text) < 220', 0.15)}", 0.0, 1.0)
_ASCII = "regexp_replace({}, '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}\\p{{M}}σö]', 'q', 'g')"
_TH, _LEAST_OVERLAP, _MISMATCH = 0.35, 0.02, 0.25


def _quality(c: Column) -> Column:
    """Evidence quality of a proposal's texts: figures and methods, less definitions and short blurbs."""
    num, met, definition = (c.rlike("(?i)" + p) for p in (lx.EVIDENCE_NUMERIC, lx.EVIDENCE_METHOD, lx.EVIDENCE_DEFINITION))
    return tx.clamp(tx.yes(num, 0.45) + tx.yes(met, 0.45) - tx.yes(definition, 0.25) - tx.yes(F.length(c) < 220, 0.15), 0.0, 1.0)


_ITEMS = f"""WITH m AS (SELECT id, query, list_distinct(list_filter(string_split(trim(regexp_replace(replace(lower(query), '-', ' '), '[\\s\\x0B]+', ' ', 'g'), ' '), ' '), lambda w: length(w) > 2)) AS ct, {_kw("query")} AS qk, chunks_json FROM training_examples),
j AS (SELECT id, query, ct, qk, unnest(from_json(chunks_json, '[{{"text":"VARCHAR","title":"VARCHAR","domain":"VARCHAR"}}]')) AS c, unnest(range(len(from_json(chunks_json, '[{{"text":"VARCHAR","title":"VARCHAR","domain":"VARCHAR"}}]')))) AS pos FROM m WHERE json_valid(chunks_json)),
w AS (SELECT id, query, ct, qk, pos, c.text AS text, coalesce(c.title, '') AS title, list_distinct(list_filter(string_split(trim(regexp_replace(replace(lower(c.text), '-', ' '), '[\\s\\x0B]+', ' ', 'g'), ' '), ' '), lambda w: length(w) > 2)) AS tt, {_kw("c.text")} AS tk FROM j WHERE trim(coalesce(c.text, '')) <> ''),
o AS (SELECT *, CASE WHEN len(ct) * len(tt) = 0 THEN 0.0 ELSE len(list_intersect(ct, tt)) / sqrt(len(ct) * len(tt)) END AS sim, CASE WHEN len(qk) = 0 OR len(tk) = 0 THEN 0.0 ELSE len(list_intersect(qk, tk)) / len(list_distinct(list_concat(qk, tk))) END AS jac, {_ASCII.format("text")} AS x FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, pos) AS rk FROM o)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of each question with similarity, keyword overlap and rank."""
    stop = F.array(*map(F.lit, lx.STOP_WORDS))
    kw = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~F.array_contains(stop, w)))
    t = table(spark, d, "training_examples").where("chunks_json is not null").select("id", "query", tx.tokens_over(F.col("query"), 2).alias("ct"), kw(F.col("query")).alias("qk"), F.posexplode(F.from_json("chunks_json", "array<struct<text:string,title:string,domain:string>>")).alias("pos", "c"))
    t = t.where(F.trim(F.coalesce("c.text", F.lit(""))) != "").select("id", "query", "ct", "qk", "pos", F.col("c.text").alias("text"), F.coalesce("c.title", F.lit("")).alias("title"), tx.tokens_over(F.col("c.text"), 2).alias("tt"), kw(F.col("c.text")).alias("tk"))
    both = F.size("ct") * F.size("tt")
    sim = F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect("ct", "tt")) / F.sqrt(both))
    jac = F.when((F.size("qk") == 0) | (F.size("tk") == 0), 0.0).otherwise(tx.jaccard(F.col("qk"), F.col("tk")))
    rk = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("sim", 9)), "pos"))
    return t.select("id", "query", "pos", "text", "title", sim.alias("sim"), jac.alias("jac")).withColumn("rk", rk)


_WARN = " + ".join(f"CAST(regexp_matches(lower(query), {sq.q(p)}) AS INT)" for p in lx.RED_FLAGS)


@query(_ITEMS + f""", q AS (SELECT *, {_QUALITY} AS quality FROM r WHERE rk <= 10),
g AS (SELECT id, any_value(query) AS query, max(sim) AS best, max(jac) FILTER (rk <= 5) AS overlap, max(quality) FILTER (rk <= 5) AS best_q, count(*) FILTER (rk <= 5 AND quality >= 0.55) AS strong, string_agg(title || ' ' || left(text, 600), ' ' ORDER BY rk) FILTER (rk <= 3) AS top FROM q GROUP BY id),
k AS (SELECT *, {_WARN} AS warns, {sq.best_bucket("lower(query)", lx.PROPOSAL_BUCKETS, "unknown")} AS pb, {sq.best_bucket("lower(top)", lx.PROPOSAL_BUCKETS, "unknown")} AS eb FROM g),
l AS (SELECT id, warns, best, best_q, pb <> 'unknown' AND eb <> 'unknown' AND pb <> eb AS mismatch, CASE WHEN best < {_TH} OR (overlap < {_LEAST_OVERLAP} AND NOT {sq.matches_any("lower(query)", lx.DEFINITIONISH)}) THEN 1 WHEN strong < 1 THEN 2 ELSE 3 END AS rung FROM k),
b AS (SELECT id, mismatch, rung, CASE rung WHEN 1 THEN CASE WHEN warns = 0 THEN 0.40 ELSE 0.30 END WHEN 2 THEN CASE WHEN warns = 0 THEN 0.35 ELSE 0.25 END ELSE least(0.85, (CASE WHEN warns = 0 THEN 0.62 ELSE 0.50 END) + 0.12 * least(1.0, best - {_TH}) + 0.10 * least(1.0, best_q)) END AS base FROM l)
SELECT id, CASE WHEN rung = 3 THEN 'supported' ELSE 'inconclusive' END AS verdict, round(CASE WHEN mismatch THEN greatest(0.10, base - {_MISMATCH}) ELSE base END, 5) AS confidence FROM b""")
def proposal_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of each question as a proposal: from retrieval, overlap and quality of its evidence, with warnings and a domain's mismatch."""
    q = _items(spark, d).where("rk <= 10").withColumn("quality", _quality(F.col("text")))
    five = F.col("rk") <= 5
    top = F.sort_array(F.collect_list(F.when(F.col("rk") <= 3, F.struct("rk", F.concat("title", F.lit(" "), F.left("text", F.lit(600))).alias("x")))))
    g = q.groupBy("id").agg(F.first("query").alias("query"), F.max("sim").alias("best"), F.max(F.when(five, F.col("jac"))).alias("overlap"), F.max(F.when(five, F.col("quality"))).alias("best_q"), F.count_if(five & (F.col("quality") >= 0.55)).alias("strong"), top.alias("top"))
    t = F.lower("query")
    pb, eb = tx.best_bucket(t, lx.PROPOSAL_BUCKETS, "unknown"), tx.best_bucket(F.lower(F.array_join(F.transform("top", lambda s: s["x"]), " ")), lx.PROPOSAL_BUCKETS, "unknown")
    warned = tx.matches_any(t, lx.RED_FLAGS)
    k = g.select("id", "best", "best_q", "strong", "overlap", pb.alias("pb"), eb.alias("eb"), warned.alias("w"), tx.matches_any(t, lx.DEFINITIONISH).alias("about"))
    rung = F.when((F.col("best") < _TH) | ((F.col("overlap") < _LEAST_OVERLAP) & ~F.col("about")), 1).when(F.col("strong") < 1, 2).otherwise(3)
    by = lambda a, b: F.when(F.col("w"), b).otherwise(a)
    base = F.when(rung == 1, by(0.40, 0.30)).when(rung == 2, by(0.35, 0.25)).otherwise(F.least(F.lit(0.85), by(0.62, 0.50) + 0.12 * F.least(F.lit(1.0), F.col("best") - _TH) + 0.10 * F.least(F.lit(1.0), F.col("best_q"))))
    mismatch = (F.col("pb") != "unknown") & (F.col("eb") != "unknown") & (F.col("pb") != F.col("eb"))
    return k.select("id", F.when(rung == 3, "supported").otherwise("inconclusive").alias("verdict"), F.round(F.when(mismatch, F.greatest(F.lit(0.10), base - _MISMATCH)).otherwise(base), 5).alias("confidence"))


@query(_EVID + """, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY round(score, 9) DESC, coalesce(title, ''), text) AS k FROM k),
g AS (SELECT claim_id, sum(CASE WHEN polarity = 'support' THEN score ELSE 0 END) AS s, sum(CASE WHEN polarity = 'contradict' THEN score ELSE 0 END) AS c, count(*) FILTER (score >= 0.3) AS strong, sum(score) FILTER (k <= 10) AS w FROM r GROUP BY claim_id)
SELECT claim_id, round(0.60 * (s / (s + c + 1e-9)) + 0.25 * least(1.0, w) + 0.15 * least(1.0, strong / 3.0), 5) AS rank_score FROM g""")
def hypothesis_scores(spark: SparkSession, d: str) -> DataFrame:
    """Rank of hypotheses: confidence, weight of the ten best pieces of evidence, and how many are strong."""
    side = lambda p: F.sum(F.when(F.col("polarity") == p, F.col("score")).otherwise(0.0))
    k = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc(F.round("score", 9)), F.coalesce("title", F.lit("")), "text"))
    g = _evidence(spark, d).withColumn("k", k).groupBy("claim_id").agg(side("support").alias("s"), side("contradict").alias("c"), F.count_if(F.col("score") >= 0.3).alias("strong"), F.sum(F.when(F.col("k") <= 10, F.col("score"))).alias("w"))
    one = F.lit(1.0)
    return g.select("claim_id", F.round(0.60 * (F.col("s") / (F.col("s") + F.col("c") + 1e-9)) + 0.25 * F.least(one, F.col("w")) + 0.15 * F.least(one, F.col("strong") / 3.0), 5).alias("rank_score"))


_M, _K = sq.first_alias("lower(t.query)", _METHODS), sq.first_alias("lower(t.query)", _METRICS)


@query(_VERDICTS + f""", kg AS (SELECT claim_id, {_M} AS method, {_K} AS metric, cv.verdict AS verdict FROM cv JOIN training_examples t ON t.id = cv.claim_id WHERE cv.confidence >= 0.45 AND cv.verdict <> 'inconclusive'),
p AS (SELECT DISTINCT e.claim_id, left(trim(e.title), 50) AS paper FROM ({_EVID} SELECT claim_id, title FROM k) e WHERE trim(coalesce(e.title, '')) <> '')
SELECT method AS subject, CASE verdict WHEN 'supported' THEN 'supports_efficiency' WHEN 'partially_supported' THEN 'partially_supports' ELSE 'contradicts' END AS relation, coalesce(metric, 'TransformerEfficiency') AS object FROM kg WHERE method IS NOT NULL
UNION SELECT kg.method, 'evidenced_by', p.paper FROM kg JOIN p USING (claim_id) WHERE kg.method IS NOT NULL""")
def graph_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Edges that confident verdicts add to the graph: what the question's method does, and the papers behind it."""
    v = _verdicts(spark, d).where("confidence >= 0.45 and verdict <> 'inconclusive'")
    t = F.lower("query")
    q = table(spark, d, "training_examples").select(F.col("id").alias("claim_id"), tx.first_alias(t, _METHODS).alias("method"), tx.first_alias(t, _METRICS).alias("metric")).where("method is not null")
    k = v.join(q, "claim_id").select("claim_id", "method", "metric", "verdict")
    papers = _evidence(spark, d).where(F.trim(F.coalesce("title", F.lit(""))) != "").select("claim_id", F.left(F.trim("title"), F.lit(50)).alias("object")).distinct()
    edges = k.select(F.col("method").alias("subject"), F.when(F.col("verdict") == "supported", "supports_efficiency").when(F.col("verdict") == "partially_supported", "partially_supports").otherwise("contradicts").alias("relation"), F.coalesce("metric", F.lit("TransformerEfficiency")).alias("object"))
    return edges.unionByName(k.join(papers, "claim_id").select(F.col("method").alias("subject"), F.lit("evidenced_by").alias("relation"), "object")).distinct()


@query(f"""WITH e AS (SELECT lower(source_concept) AS a, count(*) FILTER (lower(relation_type) IN ('supports_efficiency', 'reduces', 'increases', 'improves', 'enables')) AS pos, count(*) FILTER (lower(relation_type) IN ('has_tradeoff', 'contradicts', 'prevents')) AS neg FROM causal_relations GROUP BY 1),
q AS (SELECT t.id, lower(t.query) AS t, c.canonical_name AS n, row_number() OVER (PARTITION BY t.id ORDER BY strpos(lower(t.query), lower(c.canonical_name)), c.id) AS k FROM training_examples t JOIN concept_cells c ON lower(t.query) LIKE '%' || lower(c.canonical_name) || '%'),
b AS (SELECT q.id, q.t, CASE WHEN coalesce(pos + neg, 0) > 0 THEN least(0.85, pos / (pos + neg) * 0.9 + 0.1) ELSE 0.55 END AS base FROM q LEFT JOIN e ON e.a = lower(q.n) WHERE k = 1),
s AS (SELECT id, round(greatest(0.25, least(0.85, base * (CASE WHEN {sq.has_any("t", ("combine", "hybrid"))} THEN 0.8 ELSE 1.0 END) * (CASE WHEN {sq.has_any("t", ("stuck", "doesn't work"))} THEN 0.7 ELSE 1.0 END))) + 1e-9, 2) AS success FROM b)
SELECT id, success, round(least(0.35, (1 - success) * 0.6) + 1e-9, 2) AS partial, round(greatest(0, 1 - success - round(least(0.35, (1 - success) * 0.6) + 1e-9, 2)), 2) AS failure FROM s""")
def outcome_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Chances of an idea from the edges of the first concept it names: success, part of it, failure."""
    kind = F.lower("relation_type")
    e = table(spark, d, "causal_relations").groupBy(F.lower("source_concept").alias("n")).agg(F.count_if(kind.isin("supports_efficiency", "reduces", "increases", "improves", "enables")).alias("pos"), F.count_if(kind.isin("has_tradeoff", "contradicts", "prevents")).alias("neg"))
    c = table(spark, d, "concept_cells").select(F.col("id").alias("cid"), F.lower("canonical_name").alias("n"))
    q = like_join(c, "n", table(spark, d, "training_examples").select("id", "query"), "query").withColumn("at", F.expr("locate(n, lower(query))"))
    first = q.groupBy("id").agg(F.min(F.struct("at", "cid", "n", F.lower("query").alias("t"))).alias("s")).select("id", "s.n", "s.t")
    total = F.coalesce(F.col("pos") + F.col("neg"), F.lit(0))
    base = F.when(total > 0, F.least(F.lit(0.85), F.col("pos") / total * 0.9 + 0.1)).otherwise(0.55)
    t = F.col("t")
    p = base * F.when(tx.has_any(t, ("combine", "hybrid")), 0.8).otherwise(1.0) * F.when(tx.has_any(t, ("stuck", "doesn't work")), 0.7).otherwise(1.0)
    s = first.join(e, "n", "left").select("id", F.round(tx.clamp(p, 0.25, 0.85) + 1e-9, 2).alias("success"))
    partial = F.round(F.least(F.lit(0.35), (1 - F.col("success")) * 0.6) + 1e-9, 2)
    return s.select("id", "success", partial.alias("partial"), F.round(F.greatest(F.lit(0.0), 1 - F.col("success") - partial), 2).alias("failure"))


@query(f"""WITH x AS (SELECT coalesce(source, '(none)') AS source, {_setting_sql("lower(text)")} FROM chunks), g AS (SELECT source, list_sort(list_distinct(list(hardware) FILTER (hardware IS NOT NULL))) AS hw, list_sort(list_distinct(list(task) FILTER (task IS NOT NULL))) AS ts, list_sort(list_distinct(list(model_size) FILTER (model_size IS NOT NULL))) AS ms FROM x GROUP BY source)
SELECT source, coalesce(array_to_string(hw, '|'), '') AS hardware, coalesce(array_to_string(ts, '|'), '') AS tasks, coalesce(array_to_string(ms, '|'), '') AS model_sizes, CAST(coalesce(list_contains(hw, 'A100') AND NOT list_contains(hw, 'H100'), false) AS BOOLEAN) AS h100_untested, CAST(coalesce(list_contains(hw, 'H100') AND NOT list_contains(hw, 'A100'), false) AS BOOLEAN) AS a100_untested FROM g""")
def result_scope(spark: SparkSession, d: str) -> DataFrame:
    """What the results of a source were tested on, and what they weren't."""
    x = table(spark, d, "chunks").select(F.coalesce("source", F.lit("(none)")).alias("source"), *_setting(F.lower("text")))
    g = x.groupBy("source").agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in ("hardware", "task", "model_size")))
    has = lambda v: F.array_contains("hardware", v)
    return g.select("source", F.array_join("hardware", "|").alias("hardware"), F.array_join("task", "|").alias("tasks"), F.array_join("model_size", "|").alias("model_sizes"), (has("A100") & ~has("H100")).alias("h100_untested"), (has("H100") & ~has("A100")).alias("a100_untested"))


@query(_HOP + """, g AS (SELECT DISTINCT a, c FROM h WHERE rn <= 5), t AS (SELECT DISTINCT lower(paper_title) AS p FROM chunks WHERE paper_title IS NOT NULL AND paper_title <> 'unknown'),
n AS (SELECT g.a, g.c, count(t.p) AS partial, count(*) FILTER (t.p LIKE '%' || left(g.c, 12) || '%') AS high FROM g LEFT JOIN t ON t.p LIKE '%' || left(g.a, 12) || '%' GROUP BY 1, 2)
SELECT a, c, high, CASE WHEN high >= 2 THEN 0.2 WHEN high = 1 THEN 0.5 WHEN partial >= 3 THEN 0.7 ELSE 0.95 END::DOUBLE AS novelty FROM n""")
def hypothesis_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Novelty of two-hop hypotheses by the stored titles that name both ends or one."""
    g = cut(_two_hops(spark, d).select("a", "c").distinct())
    titles = table(spark, d, "chunks").where("paper_title is not null and paper_title <> 'unknown'").select(F.lower("paper_title").alias("p")).distinct()
    hits = like_join(g.select("a", F.left("a", F.lit(12)).alias("x")).distinct(), "x", titles, "p").select("a", "p")
    n = g.join(hits, "a", "left").groupBy("a", "c").agg(F.count("p").alias("partial"), F.count_if(F.expr("p like concat('%', left(c, 12), '%')")).alias("high"))
    return n.select("a", "c", "high", F.when(F.col("high") >= 2, 0.2).when(F.col("high") == 1, 0.5).when(F.col("partial") >= 3, 0.7).otherwise(0.95).alias("novelty"))


@query(_VERDICTS + """, x AS (SELECT coalesce(t.domain, '?') AS domain, cv.verdict FROM cv JOIN training_examples t ON t.id = cv.claim_id), gg AS (SELECT domain, count(*) AS n, count(*) FILTER (verdict IN ('inconclusive', 'partially_supported')) AS open_, count(*) FILTER (verdict = 'contradicted') AS con FROM x GROUP BY domain)
SELECT domain, n, CAST(n < 5 AS BOOLEAN) AS little_evidence, CAST(open_ > n // 2 AS BOOLEAN) AS mostly_open, CAST(con = 0 AND n >= 3 AS BOOLEAN) AS no_contradiction FROM gg""")
def knowledge_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of each domain's verdicts: little evidence, most of it open, nothing that contradicts."""
    t = table(spark, d, "training_examples").select(F.col("id").alias("claim_id"), F.coalesce("domain", F.lit("?")).alias("domain"))
    g = _verdicts(spark, d).join(t, "claim_id").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict").isin("inconclusive", "partially_supported")).alias("open"), F.count_if(F.col("verdict") == "contradicted").alias("con"))
    return g.select("domain", "n", (F.col("n") < 5).alias("little_evidence"), (F.col("open") > F.floor(F.col("n") / 2)).alias("mostly_open"), ((F.col("con") == 0) & (F.col("n") >= 3)).alias("no_contradiction"))


_PN = f"{sq.has_any('low', lx.NEGATIVE_SIGNALS)}"


@query(_ITEMS + f""", p AS (SELECT id, pos, title, text, {sq.has_any("lower(text)", lx.POSITIVE_SIGNALS)} AS plus, {sq.has_any("lower(text)", lx.NEGATIVE_SIGNALS)} OR contains(lower(text), 'no link') AS minus, ct, tt FROM r WHERE title NOT IN ('', 'unknown')),
x AS (SELECT a.id, a.pos AS pos_a, b.pos AS pos_b, least(a.title, b.title) AS t1, greatest(a.title, b.title) AS t2 FROM p a JOIN p b ON a.id = b.id AND a.pos < b.pos AND a.title <> b.title AND ((a.plus AND NOT a.minus AND b.minus) OR (b.plus AND NOT b.minus AND a.minus)) AND len(list_intersect(list_intersect(a.ct, a.tt), b.tt)) > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY id, t1, t2 ORDER BY pos_a, pos_b) AS k FROM x), l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos_a, pos_b) AS n FROM f WHERE k = 1) SELECT id, pos_a, pos_b, t1 AS paper_a, t2 AS paper_b FROM l WHERE n <= 3""")
def contradicting_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a question's chunks of different papers with opposite findings on a word of the question.

    The first pair of two papers counts, and three pairs a question. A question has a handful of chunks, which meet by its id.
    """
    low = F.lower("text")
    i = _items(spark, d).where("title not in ('', 'unknown')")
    plus, minus = tx.has_any(low, lx.POSITIVE_SIGNALS), tx.has_any(low, lx.NEGATIVE_SIGNALS) | low.contains("no link")
    words = F.array_intersect(tx.tokens_over(F.col("query"), 2), tx.tokens_over(F.col("text"), 2))
    p = i.select("id", F.col("pos").cast("long").alias("pos"), "title", plus.alias("plus"), minus.alias("minus"), words.alias("ws"))
    a, b = (p.select("id", *(F.col(c).alias(f"{c}_{x}") for c in ("pos", "title", "plus", "minus", "ws"))) for x in "ab")
    opposed = (F.col("plus_a") & ~F.col("minus_a") & F.col("minus_b")) | (F.col("plus_b") & ~F.col("minus_b") & F.col("minus_a"))
    x = a.join(b, "id").where((F.col("pos_a") < F.col("pos_b")) & (F.col("title_a") != F.col("title_b")) & opposed & F.arrays_overlap("ws_a", "ws_b"))
    x = x.select("id", "pos_a", "pos_b", F.least("title_a", "title_b").alias("paper_a"), F.greatest("title_a", "title_b").alias("paper_b"))
    x = x.groupBy("id", "paper_a", "paper_b").agg(F.min(F.struct("pos_a", "pos_b")).alias("s")).select("id", "s.pos_a", "s.pos_b", "paper_a", "paper_b")
    return x.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("pos_a", "pos_b"))).where("n <= 3").drop("n")


# ---------------------------------------------------------------- look-ups

_WORDS = "q AS (SELECT id, list_filter(string_split(lower(query), ' '), lambda w: length(w) > 3)[1:6] AS ws FROM training_examples WHERE id % 20 = 0), qw AS (SELECT DISTINCT id, unnest(ws) AS w FROM q)"


def _question_words(spark: SparkSession, d: str) -> DataFrame:
    """Words over three letters of every twentieth question, six at most."""
    t = table(spark, d, "training_examples").where("id % 20 = 0")
    return t.select(F.col("id").alias("qid"), F.explode(F.array_distinct(F.slice(tx.words_over(F.col("query"), 3), 1, 6))).alias("w"))


@query(f"""WITH {_WORDS}, a AS (SELECT DISTINCT qw.id, c.id AS cid, lower(c.canonical_name) AS n, coalesce(c.evidence_count, 0) AS ev FROM qw JOIN concept_cells c ON lower(c.canonical_name) LIKE '%' || qw.w || '%'),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ev DESC, cid) AS rk FROM a QUALIFY rk <= 5), u AS (SELECT DISTINCT n FROM k),
b AS (SELECT u.n, row_number() OVER (PARTITION BY u.n ORDER BY coalesce(b.supporting_count, 0) DESC, coalesce(b.contradicting_count, 0) DESC, b.id) AS r, coalesce(b.contradicting_count, 0) > 0 AS con FROM u JOIN beliefs b ON lower(b.concept_name) LIKE '%' || left(u.n, 30) || '%'),
r AS (SELECT u.n, count(*) AS m FROM u JOIN causal_relations r ON lower(r.source_concept) LIKE '%' || left(u.n, 30) || '%' GROUP BY 1),
bn AS (SELECT n, count(*) FILTER (r <= 8) AS nb, count(*) FILTER (con) AS nc FROM b GROUP BY n),
s AS (SELECT k.id, count(*) AS concepts, string_agg(k.n, ', ' ORDER BY k.rk) FILTER (k.rk <= 3) AS named, least(15, coalesce(sum(bn.nb), 0)) AS beliefs, least(10, coalesce(sum(least(4, coalesce(r.m, 0))), 0)) AS relations, least(5, coalesce(sum(least(3, coalesce(bn.nc, 0))), 0)) AS contradictions FROM k LEFT JOIN bn USING (n) LEFT JOIN r USING (n) GROUP BY k.id)
SELECT id, concepts, beliefs::BIGINT AS beliefs, relations::BIGINT AS relations, contradictions::BIGINT AS contradictions, named FROM s""")
def question_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What the world model knows around every twentieth question, in one job.

    Its concepts by words (five, by evidence), and of each up to eight beliefs, four relations and three
    contradicted beliefs; fifteen, ten and five of them a question.
    """
    c = table(spark, d, "concept_cells").select(F.col("id").alias("cid"), F.lower("canonical_name").alias("n"), F.coalesce("evidence_count", F.lit(0)).alias("ev"))
    a = like_join(_question_words(spark, d), "w", c, "n").select("qid", "cid", "n", "ev").distinct()
    k = cut(a.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("ev"), "cid"))).where("rk <= 5"))
    u = k.select("n", F.left("n", F.lit(30)).alias("p")).distinct()
    # counted by name first, so a name that is repeated meets each concept once
    b = table(spark, d, "beliefs").where("concept_name is not null").groupBy(F.lower("concept_name").alias("name")).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("contradicting_count") > 0).alias("con"))
    r = table(spark, d, "causal_relations").groupBy(F.lower("source_concept").alias("name")).agg(F.count(F.lit(1)).alias("m"))
    bn = like_join(u, "p", b, "name").groupBy("n").agg(F.sum("m").alias("nb"), F.sum("con").alias("nc"))
    rn = like_join(u, "p", r, "name").groupBy("n").agg(F.sum("m").alias("nr"))
    most = lambda c_, n: F.least(F.lit(n), F.coalesce(c_, F.lit(0)))
    s = k.join(bn, "n", "left").join(rn, "n", "left").groupBy("qid").agg(F.count(F.lit(1)).alias("concepts"), F.sum(most("nb", 8)).alias("b"), F.sum(most("nr", 4)).alias("r"), F.sum(most("nc", 3)).alias("c"), F.sort_array(F.collect_list(F.when(F.col("rk") <= 3, F.struct("rk", "n")))).alias("named"))
    return s.select(F.col("qid").alias("id"), "concepts", *(F.least(F.lit(n), F.col(c_)).cast("long").alias(name) for n, c_, name in ((15, "b", "beliefs"), (10, "r", "relations"), (5, "c", "contradictions"))), F.array_join(F.transform("named", lambda x: x["n"]), ", ").alias("named"))


@query(_HOP + f""", {_WORDS.replace("[1:6]", "[1:4]")}, g AS (SELECT a, c, max(round(0.85 * conf, 3)) AS conf FROM h WHERE rn <= 5 GROUP BY 1, 2),
m AS (SELECT DISTINCT qw.id, g.a, g.c, g.conf FROM qw JOIN g ON g.a LIKE '%' || qw.w || '%' OR g.c LIKE '%' || qw.w || '%') SELECT id, a, c, conf AS confidence FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY conf DESC, a, c) <= 3""")
def question_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """The three most confident hypotheses with a word of the question at either end, for every twentieth question."""
    g = cut(_two_hops(spark, d).groupBy("a", "c").agg(F.max(F.round(0.85 * F.col("conf"), 3)).alias("confidence")))
    t = table(spark, d, "training_examples").where("id % 20 = 0")
    w = t.select("id", F.explode(F.array_distinct(F.slice(tx.words_over(F.col("query"), 3), 1, 4))).alias("w"))
    ends = g.select(F.explode(F.array("a", "c")).alias("end")).distinct()
    hits = like_join(w, "w", ends, "end").select("id", "end").distinct()
    m = hits.join(g.withColumn("end", F.col("a")), "end").select("id", "a", "c", "confidence").union(hits.join(g.withColumn("end", F.col("c")), "end").select("id", "a", "c", "confidence")).distinct()
    return m.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), "a", "c"))).where("k <= 3").drop("k")


@query("""SELECT id, round(confidence, 6) AS before, round(greatest(0.05, least(0.99, 0.4 * confidence + 0.6 * (supporting_count / (supporting_count + contradicting_count)::DOUBLE))), 3) AS after FROM beliefs WHERE supporting_count + contradicting_count > 0 AND confidence IS NOT NULL AND updated_at IS NOT NULL AND (contains(lower(belief_text), 'plasticity') OR contains(lower(belief_text), 'runoff') OR contains(lower(belief_text), 'inflation')) ORDER BY updated_at DESC, id DESC LIMIT 10""")
def belief_history(spark: SparkSession, d: str) -> DataFrame:
    """The last revisions of beliefs with one of a question's words."""
    b = table(spark, d, "beliefs").where("supporting_count + contradicting_count > 0 and confidence is not null and updated_at is not null").where(tx.has_any(F.lower("belief_text"), ("plasticity", "runoff", "inflation")))
    ratio = F.col("supporting_count") / (F.col("supporting_count") + F.col("contradicting_count"))
    return b.orderBy(F.desc("updated_at"), F.desc("id")).limit(10).select("id", F.round("confidence", 6).alias("before"), F.round(tx.clamp(0.4 * F.col("confidence") + 0.6 * ratio, 0.05, 0.99), 3).alias("after"))


@query("""SELECT id, contradicting_count, confidence FROM beliefs WHERE supporting_count < 5 AND length(belief_text) > 20 AND NOT contains(belief_text, 'does not does not') AND concept_name NOT IN ('Module', 'time', 'age') ORDER BY contradicting_count DESC NULLS LAST, confidence ASC NULLS LAST, id LIMIT 5""")
def weakest_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """The beliefs most in need of a test."""
    b = table(spark, d, "beliefs").where("supporting_count < 5 and length(belief_text) > 20 and not contains(belief_text, 'does not does not') and concept_name not in ('Module', 'time', 'age')")
    return b.orderBy(F.desc_nulls_last("contradicting_count"), F.asc_nulls_last("confidence"), "id").limit(5).select("id", "contradicting_count", "confidence")


_CROSS_B = """WITH o AS (SELECT DISTINCT lower(concept_name) AS s, domain FROM beliefs WHERE concept_name IS NOT NULL AND domain IS NOT NULL AND domain NOT IN ('unknown', 'other', 'general')),
r AS (SELECT id, lower(source_concept) AS a, lower(relation_type) AS rel, lower(target_concept) AS b, confidence FROM causal_relations WHERE confidence >= 0.7 AND source_concept <> '' AND target_concept <> ''),
x AS (SELECT DISTINCT r.id, r.a, r.rel, r.b, r.confidence, o1.domain AS domain_a, o2.domain AS domain_b FROM r JOIN o o1 ON o1.s LIKE '%' || left(r.a, 20) || '%' JOIN o o2 ON o2.s LIKE '%' || left(r.b, 20) || '%' WHERE o1.domain <> o2.domain)"""


def _cross_beliefs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "beliefs").where("concept_name is not null and domain is not null and domain not in ('unknown', 'other', 'general')").select(F.lower("concept_name").alias("s"), "domain").distinct()
    r = table(spark, d, "causal_relations").where("confidence >= 0.7 and source_concept <> '' and target_concept <> ''").select("id", F.lower("source_concept").alias("a"), F.lower("relation_type").alias("rel"), F.lower("target_concept").alias("b"), "confidence")
    side = lambda c, name: like_join(r.select(c, F.left(c, F.lit(20)).alias("p")).distinct(), "p", o, "s").select(c, F.col("domain").alias(name)).distinct()
    return r.join(side("a", "domain_a"), "a").join(side("b", "domain_b"), "b").where("domain_a <> domain_b")


@query(_CROSS_B + " SELECT id, domain_a, domain_b FROM x")
def cross_domain_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """Relations between concepts that beliefs of different domains are about."""
    return _cross_beliefs(spark, d).select("id", "domain_a", "domain_b").distinct()


@query(_CROSS_B + """, u AS (SELECT left(a || ' [' || rel || '] ' || b, 200) AS title, domain_a, domain_b, rel AS kind, confidence FROM x UNION ALL
SELECT left(lower(source_concept) || ' is analogous to ' || lower(target_concept), 200), 'cross-domain', 'cross-domain', 'analogous_to', confidence FROM causal_relations WHERE lower(relation_type) IN ('analogous_to', 'shares_mechanism', 'generalizes') AND confidence >= 0.6)
SELECT title, domain_a, domain_b, kind, round(confidence, 6) AS confidence FROM (SELECT DISTINCT * FROM u) ORDER BY u.confidence DESC, title, domain_a, domain_b LIMIT 10""".replace("ORDER BY u.confidence", "ORDER BY confidence"))
def discoveries(spark: SparkSession, d: str) -> DataFrame:
    """The ten most confident discoveries: relations across domains, and analogies."""
    x = _cross_beliefs(spark, d).select(F.left(F.concat("a", F.lit(" ["), "rel", F.lit("] "), "b"), F.lit(200)).alias("title"), "domain_a", "domain_b", F.col("rel").alias("kind"), "confidence")
    across = F.lit("cross-domain")
    y = table(spark, d, "causal_relations").where(F.lower("relation_type").isin("analogous_to", "shares_mechanism", "generalizes") & (F.col("confidence") >= 0.6))
    y = y.select(F.left(F.concat(F.lower("source_concept"), F.lit(" is analogous to "), F.lower("target_concept")), F.lit(200)).alias("title"), across.alias("domain_a"), across.alias("domain_b"), F.lit("analogous_to").alias("kind"), "confidence")
    return x.unionByName(y).distinct().withColumn("confidence", F.round("confidence", 6)).orderBy(F.desc("confidence"), "title", "domain_a", "domain_b").limit(10)


_PRO = "WITH p AS (SELECT lower(concept_name) AS c, avg(confidence) FILTER (supporting_count > contradicting_count) AS conf, avg(CASE WHEN supporting_count > contradicting_count THEN 1.0 ELSE 0.0 END) AS share, count(*) FILTER (contradicting_count > 0) AS contested FROM beliefs WHERE supporting_count IS NOT NULL AND contradicting_count IS NOT NULL GROUP BY 1)"


@query(_PRO + """, g AS (SELECT r.id, lower(r.source_concept) AS a, r.confidence, round(0.6 * (1 - 2 * abs(r.confidence - 0.5)) + least(0.4, 0.1 * coalesce(p.contested, 0)), 3) AS gain, round(coalesce(p.conf * p.share * 0.9, 0.3) + 1e-9, 4) AS simulated FROM causal_relations r LEFT JOIN p ON p.c = lower(r.source_concept) WHERE r.confidence IS NOT NULL)
SELECT id, gain, simulated, CASE WHEN simulated >= 0.75 THEN 'SUPPORTED' WHEN simulated >= 0.45 THEN 'INCONCLUSIVE' ELSE 'REJECTED' END AS outcome, CASE WHEN (simulated - confidence) * 100 > 10 THEN 'strong' WHEN (simulated - confidence) * 100 > 0 THEN 'weak' WHEN (simulated - confidence) * 100 > -5 THEN 'null' ELSE 'negative' END AS result FROM g ORDER BY gain DESC, id LIMIT 3""")
def research_cycle(spark: SparkSession, d: str) -> DataFrame:
    """One cycle of research: the three relations whose test would tell most, simulated, with outcome and result."""
    wins = F.col("supporting_count") > F.col("contradicting_count")
    p = table(spark, d, "beliefs").where("supporting_count is not null and contradicting_count is not null").groupBy(F.lower("concept_name").alias("c")).agg(F.avg(F.when(wins, F.col("confidence"))).alias("conf"), F.avg(wins.cast("double")).alias("share"), F.count_if(F.col("contradicting_count") > 0).alias("contested"))
    r = table(spark, d, "causal_relations").where("confidence is not null").select("id", F.lower("source_concept").alias("c"), "confidence")
    gain = F.round(0.6 * (1 - 2 * F.abs(F.col("confidence") - 0.5)) + F.least(F.lit(0.4), 0.1 * F.coalesce("contested", F.lit(0))), 3)
    g = r.join(p.withColumnRenamed("conf", "pc"), "c", "left").select("id", "confidence", gain.alias("gain"), F.round(F.coalesce(F.col("pc") * F.col("share") * 0.9, F.lit(0.3)) + 1e-9, 4).alias("simulated")).orderBy(F.desc("gain"), "id").limit(3)
    s, change = F.col("simulated"), (F.col("simulated") - F.col("confidence")) * 100
    return g.select("id", "gain", "simulated", F.when(s >= 0.75, "SUPPORTED").when(s >= 0.45, "INCONCLUSIVE").otherwise("REJECTED").alias("outcome"), F.when(change > 10, "strong").when(change > 0, "weak").when(change > -5, "null").otherwise("negative").alias("result"))


_SEEK = ("plasticity", "coating", "inflation")


@query(f"""WITH pub AS (SELECT 'public' AS origin, belief_text AS belief, supporting_count AS n, id FROM beliefs WHERE {sq.has_any("lower(belief_text)", _SEEK)}),
priv AS (SELECT 'private' AS origin, trim(subject) || ' ' || trim(predicate) || ' ' || trim(object) AS belief, count(*) AS n, min(id) AS id FROM observations WHERE company_id IS NOT NULL AND subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL GROUP BY 2 HAVING {sq.has_any("lower(trim(subject) || ' ' || trim(predicate) || ' ' || trim(object))", _SEEK)})
SELECT origin, id, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY coalesce(n, 0) DESC, id) AS k FROM (SELECT * FROM pub UNION ALL SELECT * FROM priv)) WHERE k <= 10""")
def combined_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """The ten best founded public beliefs on a question's words, and the tenants' own."""
    b = table(spark, d, "beliefs").where(tx.has_any(F.lower("belief_text"), _SEEK)).select(F.lit("public").alias("origin"), "id", F.col("supporting_count").cast("long").alias("n"))
    text = F.concat(F.trim("subject"), F.lit(" "), F.trim("predicate"), F.lit(" "), F.trim("object"))
    o = table(spark, d, "observations").where("company_id is not null and subject is not null and predicate is not null and object is not null").select("id", text.alias("t")).where(tx.has_any(F.lower("t"), _SEEK))
    o = o.groupBy("t").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select(F.lit("private").alias("origin"), "id", "n")
    best = lambda x: x.orderBy(F.desc(F.coalesce("n", F.lit(0))), "id").limit(10)
    return best(b).unionByName(best(o))


@query(f"""WITH k AS (SELECT lower(concept_name) AS c, sum(contradicting_count) AS contra FROM beliefs GROUP BY 1), s AS (SELECT id, evidence_count, {_LIFE} AS state FROM (SELECT c.*, coalesce(k.contra, 0) AS contra FROM concept_cells c LEFT JOIN k ON lower(c.canonical_name) = k.c)),
u AS (SELECT 'threat' AS kind, id, (contradicting_count * supporting_count)::DOUBLE AS v FROM beliefs WHERE contradicting_count > 0 AND supporting_count >= 3 AND length(belief_text) > 40 AND length(belief_text) < 200 AND NOT {sq.has_any("belief_text", ("does not does not", "not mentioned", "not applicable", "Creative Commons", "license", "copyright"))} AND concept_name NOT IN ('Module', 'time', 'age', 'Intervention') AND domain NOT IN ('unknown', 'other')
UNION ALL SELECT state, id, evidence_count::DOUBLE FROM s WHERE state IN ('established', 'emerging') UNION ALL SELECT 'causal', id, confidence FROM causal_relations WHERE length(source_concept) > 5 AND length(target_concept) > 5 AND confidence IS NOT NULL)
SELECT kind, id, k FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY v DESC NULLS LAST, id) AS k FROM u) WHERE k <= 3 OR (kind = 'causal' AND k <= 4)""")
def company_brief(spark: SparkSession, d: str) -> DataFrame:
    """A tenant's brief: contested beliefs, established and emerging concepts, and the firmest relations."""
    from strataclaim.operators.evidence import lifecycle

    bad = ("does not does not", "not mentioned", "not applicable", "Creative Commons", "license", "copyright")
    b = table(spark, d, "beliefs")
    threats = b.where("contradicting_count > 0 and supporting_count >= 3 and length(belief_text) > 40 and length(belief_text) < 200 and concept_name not in ('Module', 'time', 'age', 'Intervention') and domain not in ('unknown', 'other')").where(~tx.has_any(F.col("belief_text"), bad))
    k = b.groupBy(F.lower("concept_name").alias("c")).agg(F.sum("contradicting_count").alias("contra"))
    cells = table(spark, d, "concept_cells")
    s = cells.join(k, F.lower(cells.canonical_name) == k.c, "left").select("id", "evidence_count", lifecycle(F.col("evidence_count"), F.col("confidence_score"), F.coalesce("contra", F.lit(0))).alias("state"))

    def top(df: DataFrame, kind: str, v: Column, n: int) -> DataFrame:
        rows = df.select("id", v.cast("double").alias("v")).orderBy(F.desc_nulls_last("v"), "id").limit(n)
        return rows.select(F.lit(kind).alias("kind"), "id", F.row_number().over(Window.orderBy(F.desc_nulls_last("v"), "id")).cast("long").alias("k"))

    out = top(threats, "threat", F.col("contradicting_count") * F.col("supporting_count"), 3)
    for state in ("established", "emerging"):
        out = out.unionByName(top(s.where(F.col("state") == state), state, F.col("evidence_count"), 3))
    return out.unionByName(top(table(spark, d, "causal_relations").where("length(source_concept) > 5 and length(target_concept) > 5 and confidence is not null"), "causal", F.col("confidence"), 4))


@query("SELECT id, left(query, 30) || '...' AS label FROM training_examples ORDER BY id DESC LIMIT 8")
def recent_questions(spark: SparkSession, d: str) -> DataFrame:
    """The eight newest questions, as topics."""
    return table(spark, d, "training_examples").orderBy(F.desc("id")).limit(8).select("id", F.concat(F.left("query", F.lit(30)), F.lit("...")).alias("label"))


@query("SELECT coalesce(domain, '?') AS domain, coalesce(max(iterations), 0) + 1 AS next_cycle FROM training_examples GROUP BY 1")
def next_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Number of the next cycle of each domain."""
    return table(spark, d, "training_examples").groupBy(F.coalesce("domain", F.lit("?")).alias("domain")).agg((F.coalesce(F.max("iterations"), F.lit(0)) + 1).alias("next_cycle"))


_ASKED = ("plasticity", "cortical", "arousal", "memory")


@query(f"""WITH h AS (SELECT chunk_id, {sq.has_any("lower(text)", _ASKED)} AS hit FROM chunks WHERE domain = 'neuroscience'), n AS (SELECT count(*) FILTER (hit) AS n FROM h)
SELECT chunk_id FROM h, n WHERE hit OR n.n < 2 ORDER BY md5(chunk_id::VARCHAR) LIMIT 8""")
def domain_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Eight chunks of a domain with a word of the question; of the whole domain if fewer than two have one."""
    h = table(spark, d, "chunks").where("domain = 'neuroscience'").select("chunk_id", tx.has_any(F.lower("text"), _ASKED).alias("hit"))
    # the first eight in the order of a hash, of those with a word and of all
    first = lambda x: x.orderBy(F.md5(F.col("chunk_id").cast("string"))).limit(8).select("chunk_id")
    some = first(h.where("hit"))
    enough = some.agg((F.count(F.lit(1)) >= 2).alias("ok"))
    return some.join(F.broadcast(enough), F.col("ok")).select("chunk_id").unionByName(first(h).join(F.broadcast(enough), ~F.col("ok")).select("chunk_id"))


@query("""WITH g AS (SELECT coalesce(domain, '?') AS domain, upper(trim(coalesce(verdict, ''), ' ')) AS v, count(*) AS n FROM training_examples GROUP BY 1, 2), f AS (SELECT domain, v, n FROM g WHERE n >= 2 AND v <> '')
SELECT domain, string_agg(v || '=' || (n * 10)::VARCHAR, ',' ORDER BY v) AS tenfold, arg_max(v, (n, v)) AS most FROM f GROUP BY domain""")
def verdict_maps(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of each domain as a map: entries of two or more, values changed, and the key of the highest value."""
    g = table(spark, d, "training_examples").groupBy(F.coalesce("domain", F.lit("?")).alias("domain"), F.upper(F.trim(F.coalesce("verdict", F.lit("")))).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    m = g.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("m"))
    m = m.withColumn("m", F.map_filter("m", lambda k, v: (v >= 2) & (k != ""))).where(F.size("m") > 0)
    ten = F.transform_values("m", lambda k, v: v * 10)
    entries = F.array_sort(F.map_entries(ten))
    most = F.array_max(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("k"))))["k"]
    return m.select("domain", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("tenfold"), most.alias("most"))


@query(_ITEMS + """, t AS (SELECT r.id, r.pos, r.sim, coalesce(t.domain, '') AS domain FROM r JOIN training_examples t ON t.id = r.id) SELECT id, pos, place FROM (SELECT id, pos, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN domain = 'ml_ai' THEN 0 ELSE 1 END, round(sim, 9) DESC, id, pos) AS place FROM t) WHERE place <= 5""")
def ranked_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar pieces of evidence of each domain, ties in the order they came."""
    t = table(spark, d, "training_examples").select("id", F.coalesce("domain", F.lit("")).alias("domain"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc(F.round("sim", 9)), "id", "pos")).cast("long")
    return _items(spark, d).join(t, "id").withColumn("place", place).where("place <= 5").select("id", F.col("pos").cast("long").alias("pos"), "place")


# ---------------------------------------------------------------- retrieval measured against expected passages

_TOK = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z]{{5,}}'), lambda w: NOT list_contains([" + ", ".join(map(sq.q, lx.QUESTION_STOP_WORDS)) + "], w)))"


@query(f"""WITH c AS (SELECT min(chunk_id) AS id, any_value(lower(text)) AS low, {_TOK.format("any_value(text)")} AS ws FROM chunks GROUP BY md5(text)),
i AS (SELECT item_id, {_TOK.format("question")} AS qs, {_TOK.format("text")} AS es, keywords FROM eval_items),
s AS (SELECT i.item_id, c.id, len(list_intersect(i.qs, c.ws)) / sqrt(len(i.qs) * len(c.ws)) AS sim FROM i JOIN c ON list_has_any(i.qs, c.ws)),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, id) AS rk FROM s QUALIFY rk <= 8),
e AS (SELECT k.item_id, c.id, c.low, CASE WHEN len(i.es) * len(c.ws) = 0 THEN 0.0 ELSE len(list_intersect(i.es, c.ws)) / sqrt(len(i.es) * len(c.ws)) END AS best, i.keywords FROM k JOIN c ON c.id = k.id JOIN i ON i.item_id = k.item_id),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(best, 9) DESC, id) = 1),
z AS (SELECT ws FROM c ORDER BY md5(id::VARCHAR) LIMIT 64), r AS (SELECT i.item_id, max(CASE WHEN len(i.es) * len(z.ws) = 0 THEN 0.0 ELSE len(list_intersect(i.es, z.ws)) / sqrt(len(i.es) * len(z.ws)) END) AS rnd FROM i, z GROUP BY 1)
SELECT b.item_id, round(b.best, 4) AS best_similarity, round(b.best - r.rnd, 4) AS gap, CAST(round(b.best, 9) >= 0.55 AS BOOLEAN) AS recall_hit, round(len(list_filter(b.keywords, lambda w: contains(b.low, lower(w)))) / greatest(1, len(b.keywords)), 3) AS keyword_hit FROM b JOIN r USING (item_id)""")
def retrieval_recall(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval measured on the evaluation items: eight chunks by the question, the best of them against the expected passage.

    Chunks are deduplicated; vectors are unit vectors of words. A question's words, of which there are a few
    a fixed item, are broadcast and meet the chunks' words; similarities are counted, and each item keeps eight. The
    baseline is the best of 64 chunks in the order of a hash.
    """
    stop = F.array(*map(F.lit, lx.QUESTION_STOP_WORDS))
    ws = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{5,}"), F.lit(0)), lambda w: ~F.array_contains(stop, w)))
    c = cut(table(spark, d, "chunks").groupBy(F.md5("text")).agg(F.min("chunk_id").alias("id"), F.first(F.lower("text")).alias("low")).select("id", "low", ws(F.col("low")).alias("ws")))
    i = table(spark, d, "eval_items").select("item_id", ws(F.col("question")).alias("qs"), ws(F.col("text")).alias("es"), "keywords")
    asked, _ = broadcast_checked(i.select("item_id", F.size("qs").alias("nq"), F.explode("qs").alias("w")))
    s = c.select("id", F.size("ws").alias("nc"), F.explode("ws").alias("w")).join(asked, "w").groupBy("item_id", "id", "nq", "nc").agg(F.count(F.lit(1)).alias("n"))
    k = s.withColumn("sim", F.round(F.col("n") / F.sqrt(F.col("nq") * F.col("nc")), 9)).withColumn("rk", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("sim"), "id"))).where("rk <= 8")
    cosine = lambda a, b: F.when(F.size(a) * F.size(b) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b)))
    e = k.select("item_id", "id").join(c, "id").join(i, "item_id").withColumn("best", cosine(F.col("es"), F.col("ws")))
    b = e.groupBy("item_id").agg(F.min(F.struct((-F.round("best", 9)).alias("o"), "id", "best", "low", "keywords")).alias("s")).select("item_id", "s.*")
    z = F.broadcast(c.orderBy(F.md5(F.col("id").cast("string"))).limit(64).agg(F.collect_list("ws").alias("zs")))
    r = i.join(z, F.lit(True)).select("item_id", F.array_max(F.transform("zs", lambda x: cosine(F.col("es"), x))).alias("rnd"))
    hit = F.size(F.filter("keywords", lambda w: F.col("low").contains(F.lower(w)))) / F.greatest(F.lit(1), F.size("keywords"))
    return b.join(r, "item_id").select("item_id", F.round("best", 4).alias("best_similarity"), F.round(F.col("best") - F.col("rnd"), 4).alias("gap"), (F.round("best", 9) >= 0.55).alias("recall_hit"), F.round(hit, 3).alias("keyword_hit"))
