"""Queries of scans, ingestion, upserts and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataclaim.functions import lexicons as lx
from strataclaim.functions import sqltext as sq
from strataclaim.functions import text as tx
from strataclaim.plans.catalog import query
from strataclaim.session import table

_SQ = "trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g'), ' ')"


@query("SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM chunks WHERE length(text) > 100 GROUP BY source")
def scan_long_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of over 100 characters, by source."""
    return table(spark, d, "chunks").where(F.length("text") > 100).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT c.chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM observations o WHERE o.chunk_id = c.chunk_id)")
def unprocessed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks from which nothing was observed yet: an anti join with the ledger."""
    seen = table(spark, d, "observations").select("chunk_id").where("chunk_id is not null").distinct()
    return table(spark, d, "chunks").join(seen, "chunk_id", "left_anti").select("chunk_id")


@query("SELECT source, chunk_id FROM (SELECT source, chunk_id, row_number() OVER (PARTITION BY source ORDER BY md5('7' || chunk_id::VARCHAR), chunk_id) AS rn FROM chunks WHERE source IS NOT NULL) WHERE rn <= 3")
def sample_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """Three chunks of each source in hash order: a random sample that can be repeated."""
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("7"), F.col("chunk_id").cast("string"))), "chunk_id")
    return table(spark, d, "chunks").where("source is not null").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("source", "chunk_id")


@query("SELECT chunk_id, created FROM (SELECT chunk_id, strftime(created_at, '%Y-%m-%d') AS created FROM chunks ORDER BY created_at DESC, chunk_id DESC LIMIT 200 OFFSET 100)")
def paged_recent(spark: SparkSession, d: str) -> DataFrame:
    """A page of the newest chunks."""
    return table(spark, d, "chunks").orderBy(F.desc("created_at"), F.desc("chunk_id")).offset(100).limit(200).select("chunk_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


_UPSERT = f"""WITH c AS (SELECT chunk_id, {_SQ} AS t, trim(coalesce(paper_title, '')) AS title FROM chunks),
ok AS (SELECT chunk_id, sha1(t) AS k FROM c WHERE length(t) >= 160 AND lower(t) <> lower(title)), f AS (SELECT k, min(chunk_id) AS chunk_id FROM ok GROUP BY k)"""


@query(_UPSERT + " SELECT chunk_id, k AS dedupe_key FROM f")
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that an empty store keeps: long enough, not their title, the first of each content."""
    c = table(spark, d, "chunks").select("chunk_id", tx.squeeze(F.col("text")).alias("t"), F.trim(F.coalesce("paper_title", F.lit(""))).alias("title"))
    ok = c.where((F.length("t") >= 160) & (F.lower("t") != F.lower("title")))
    return ok.groupBy(F.sha1("t").alias("dedupe_key")).agg(F.min("chunk_id").alias("chunk_id")).select("chunk_id", "dedupe_key")


@query(_UPSERT + " SELECT (SELECT count(*) FROM f) AS added, (SELECT count(*) FROM chunks) - (SELECT count(*) FROM f) AS skipped")
def upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks an upsert adds and skips."""
    t = tx.squeeze(F.col("text"))
    fit = (F.length(t) >= 160) & (F.lower(t) != F.lower(F.trim(F.coalesce("paper_title", F.lit("")))))
    counts = table(spark, d, "chunks").agg(F.count(F.lit(1)).alias("total"), F.count_distinct(F.when(fit, F.sha1(t))).alias("added"))
    return counts.select("added", (F.col("total") - F.col("added")).alias("skipped"))


@query("""WITH w AS (SELECT doc_id, title, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '[\\s\\x0B]+', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT doc_id, unnest(range(0, greatest(len(ws), 1), 200)) AS k, ws FROM w),
p AS (SELECT doc_id, CAST(floor(k / 200) AS INT) AS idx, array_to_string(ws[k + 1:k + 200], ' ') AS piece FROM c),
h AS (SELECT *, row_number() OVER (PARTITION BY md5(lower(trim(piece, ' '))) ORDER BY doc_id, idx) AS rn FROM p WHERE length(piece) >= 50)
SELECT doc_id, idx, md5(lower(trim(piece, ' '))) AS chunk_hash FROM h WHERE rn = 1""")
def ingest_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut to chunks of 200 words, the first of each content kept."""
    p = table(spark, d, "documents").select("doc_id", F.posexplode(tx.word_chunks(F.coalesce("text", F.lit("")), 200, 200)).alias("idx", "piece")).where(F.length("piece") >= 50)
    first = p.groupBy(F.md5(F.lower(F.trim("piece"))).alias("chunk_hash")).agg(F.min(F.struct("doc_id", "idx")).alias("s"))
    return first.select("s.doc_id", "s.idx", "chunk_hash")


@query(f"""SELECT id, left(subject, 200) AS subject, left(predicate, 100) AS predicate, left(object, 200) AS object, coalesce(confidence, 0.75) AS confidence, coalesce(negated, false) AS negated FROM observations
WHERE coalesce(subject, '') <> '' AND coalesce(predicate, '') <> '' AND coalesce(object, '') <> '' AND NOT {sq.has_any("lower(subject || ' ' || predicate || ' ' || object)", lx.OBSERVATION_NOISE)}""")
def save_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations fit to store: complete, no noise, cut, with defaults."""
    o = table(spark, d, "observations").where("coalesce(subject, '') <> '' and coalesce(predicate, '') <> '' and coalesce(object, '') <> ''")
    o = o.where(~tx.has_any(F.lower(F.concat_ws(" ", "subject", "predicate", "object")), lx.OBSERVATION_NOISE))
    return o.select("id", F.left("subject", F.lit(200)).alias("subject"), F.left("predicate", F.lit(100)).alias("predicate"), F.left("object", F.lit(200)).alias("object"), F.coalesce("confidence", F.lit(0.75)).alias("confidence"), F.coalesce("negated", F.lit(False)).alias("negated"))


@query(f"""SELECT id FROM observations WHERE lower(trim(coalesce(predicate, ''))) NOT IN ({", ".join(map(sq.q, lx.VAGUE_PREDICATES))}) AND lower(trim(coalesce(subject, ''))) NOT IN ({", ".join(map(sq.q, lx.NOISE_CONCEPTS))}) AND length(trim(coalesce(subject, ''))) >= 4 AND length(trim(coalesce(object, ''))) >= 4""")
def filter_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations without vague predicates and generic subjects."""
    s = F.trim(tx.low("subject"))
    return table(spark, d, "observations").where(~F.trim(tx.low("predicate")).isin(*lx.VAGUE_PREDICATES) & ~s.isin(*lx.NOISE_CONCEPTS) & (F.length(s) >= 4) & (F.length(F.trim(F.coalesce("object", F.lit("")))) >= 4)).select("id")


@query("""SELECT lower(source_concept) AS source, relation_type AS relation, left(lower(target_concept), 30) AS target, round(least(0.95, min_by(confidence, id) + 0.02 * (count(*) - 1)), 6) AS confidence, (min_by(evidence_count, id) + count(*) - 1)::BIGINT AS evidence
FROM causal_relations WHERE confidence IS NOT NULL AND evidence_count IS NOT NULL GROUP BY ALL""")
def upsert_causal(spark: SparkSession, d: str) -> DataFrame:
    """Causal relations folded by source, relation and target: each repeat strengthens the first."""
    r = table(spark, d, "causal_relations").where("confidence is not null and evidence_count is not null")
    n = F.count(F.lit(1))
    g = r.groupBy(F.lower("source_concept").alias("source"), F.col("relation_type").alias("relation"), F.left(F.lower("target_concept"), F.lit(30)).alias("target"))
    return g.agg(F.round(F.least(F.lit(0.95), F.min_by("confidence", "id") + 0.02 * (n - 1)), 6).alias("confidence"), (F.min_by("evidence_count", "id") + n - 1).alias("evidence"))


@query("""WITH o AS (SELECT lower(trim(subject)) AS c, id, confidence FROM observations WHERE trim(coalesce(subject, '')) <> '' AND confidence IS NOT NULL),
l AS (SELECT c, list(confidence ORDER BY id) AS xs, max(id) AS last_id FROM o GROUP BY c)
SELECT c AS concept, len(xs)::BIGINT AS evidence, last_id, round(list_reduce(xs, lambda a, b: (a + b) / 2) + 1e-9, 4) AS confidence FROM l""")
def strengthen_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts folded over their observations in order: the confidence is the mean of old and new.

    The fold halves the weight of all that came before, so it is the sum of x_k / 2**(n - k + 1) (twice
    that for the first). Ranks come from one window by concept, and the weighted sum is combined on
    the map side; no group is gathered, however large.
    """
    o = table(spark, d, "observations").select(F.lower(F.trim("subject")).alias("concept"), "id", "confidence").where("concept <> '' and confidence is not null")
    back = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("id")))
    n = F.count(F.lit(1)).over(Window.partitionBy("concept"))
    o = o.withColumns({"back": back, "n": n})
    part = F.col("confidence") * F.pow(F.lit(0.5), F.least(F.when(F.col("back") == F.col("n"), F.col("n") - 1).otherwise(F.col("back")), F.lit(1000)))
    return o.groupBy("concept").agg(F.count(F.lit(1)).alias("evidence"), F.max("id").alias("last_id"), F.round(F.sum(part) + 1e-9, 4).alias("confidence"))


@query("SELECT company_id, max_by(id, (created_at, id)) AS last_id, count(*) AS n FROM private_papers WHERE company_id IS NOT NULL GROUP BY company_id")
def last_upload(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each tenant: an upsert in which the newest wins."""
    return table(spark, d, "private_papers").where("company_id is not null").groupBy("company_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("last_id"), F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT lower(query) AS k, id, verdict FROM training_examples), l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id DESC) AS rn FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY split_part(k, ' ', 1) ORDER BY id DESC) AS pn FROM l WHERE rn = 1) SELECT id, split_part(k, ' ', 1) AS first_word, pn FROM p WHERE pn <= 4""")
def recent_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each text, and of these the last four of each first word."""
    last = table(spark, d, "training_examples").groupBy(F.lower("query").alias("k")).agg(F.max("id").alias("id")).withColumn("first_word", F.split_part("k", F.lit(" "), F.lit(1)))
    return last.withColumn("pn", F.row_number().over(Window.partitionBy("first_word").orderBy(F.desc("id"))).cast("long")).where("pn <= 4").select("id", "first_word", "pn")


_WORDS = ("plasticity", "membrane", "runoff", "attention")


@query(f"SELECT id FROM beliefs WHERE {' OR '.join(f'lower(belief_text) LIKE {sq.q(chr(37) + w + chr(37))}' for w in _WORDS)}")
def beliefs_by_words(spark: SparkSession, d: str) -> DataFrame:
    """Beliefs that contain any of the words of a query."""
    t = F.lower("belief_text")
    hit = t.like(f"%{_WORDS[0]}%")
    for w in _WORDS[1:]:
        hit = hit | t.like(f"%{w}%")
    return table(spark, d, "beliefs").where(hit).select("id")


@query("SELECT id FROM observations WHERE lower(subject) LIKE lower('%DOPAMINERGIC_PLASTICITY%')")
def like_with_wildcards(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive substring match in which ``_`` in the pattern stays a wildcard."""
    return table(spark, d, "observations").where(F.lower("subject").like("%dopaminergic_plasticity%")).select("id")


@query("SELECT id, CAST(lower(canonical_name) = lower('Dopaminergic Plasticity') AS BOOLEAN) AS is_same, length(canonical_name) AS n FROM concept_cells WHERE length(canonical_name) > 14 AND canonical_name NOT LIKE '%the %'")
def concept_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Equality without case, lengths and negated matches."""
    n = F.col("canonical_name")
    return table(spark, d, "concept_cells").where((F.length(n) > 14) & ~n.like("%the %")).select("id", (F.lower(n) == "dopaminergic plasticity").alias("is_same"), F.length(n).cast("long").alias("n"))


@query("SELECT id FROM beliefs WHERE lower(belief_text) LIKE '%plasticity%' OR lower(concept_name) LIKE '%plasticity%' AND contradicting_count = 0")
def loose_precedence(spark: SparkSession, d: str) -> DataFrame:
    """A disjunction whose last filter binds to its last arm only."""
    return table(spark, d, "beliefs").where(F.lower("belief_text").like("%plasticity%") | (F.lower("concept_name").like("%plasticity%") & (F.col("contradicting_count") == 0))).select("id")


@query("SELECT id FROM beliefs WHERE confidence BETWEEN 0.4 AND 0.7 AND supporting_count >= 2 AND domain = 'medicine'")
def threshold_filter(spark: SparkSession, d: str, domain: str | None = "medicine") -> DataFrame:
    """Thresholds, with a filter by domain if one is given."""
    b = table(spark, d, "beliefs").where("confidence between 0.4 and 0.7 and supporting_count >= 2")
    return (b.where(F.col("domain") == domain) if domain else b).select("id")


@query("""SELECT 'chunks' AS src, chunk_id AS id, left(coalesce(paper_title, ''), 40) AS title FROM chunks UNION ALL SELECT 'documents', doc_id, left(coalesce(title, ''), 40) FROM documents UNION ALL SELECT 'private_papers', id, left(coalesce(title, ''), 40) FROM private_papers""")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    """Papers of several sources, one after the other."""
    one = lambda name, key, title: table(spark, d, name).select(F.lit(name).alias("src"), F.col(key).alias("id"), F.left(F.coalesce(title, F.lit("")), F.lit(40)).alias("title"))
    return one("chunks", "chunk_id", "paper_title").unionByName(one("documents", "doc_id", "title")).unionByName(one("private_papers", "id", "title"))


@query("""SELECT subject FROM (SELECT lower(subject) AS subject FROM observations WHERE subject IS NOT NULL INTERSECT SELECT lower(source_concept) FROM causal_relations EXCEPT SELECT lower(concept_name) FROM beliefs)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Subjects that cause something and that no belief is about."""
    o = table(spark, d, "observations").where("subject is not null").select(F.lower("subject").alias("subject"))
    return o.intersect(table(spark, d, "causal_relations").select(F.lower("source_concept").alias("subject"))).subtract(table(spark, d, "beliefs").where("concept_name is not null").select(F.lower("concept_name").alias("subject")))


@query("""SELECT b.id, unnest(from_json(r.source_beliefs, '["BIGINT"]')) AS belief_id FROM causal_relations r JOIN (SELECT id FROM causal_relations) b ON b.id = r.id WHERE r.source_beliefs IS NOT NULL AND json_valid(r.source_beliefs)""")
def relation_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """Beliefs a relation was drawn from: arrays in JSON text, exploded."""
    return table(spark, d, "causal_relations").select("id", F.explode(F.from_json("source_beliefs", "array<bigint>")).alias("belief_id"))
