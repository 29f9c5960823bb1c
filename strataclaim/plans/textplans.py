"""Queries of the text operators: normalising, chunking, splitting, classifying, scoring."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataclaim.functions import lexicons as lx
from strataclaim.functions import sqltext as sq
from strataclaim.functions import text as tx
from strataclaim.plans.catalog import query
from strataclaim.session import table

_SENTENCES = "list_filter(list_transform(string_split(regexp_replace({}, '([.!?])[\\s\\x0B]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '[\\s\\x0B]+', ' ', 'g'), ' ')), lambda s: s <> '')"


@query("""SELECT chunk_id, sha1(trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g'), ' ')) AS dedupe_key, md5(lower(trim(text, ' '))) AS ingest_key, 'clm_' || left(sha1(text), 12) AS stable_id, left(md5(left(lower(trim(text, ' ')), 100)), 12) AS claim_key FROM chunks""")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """The four normalisation keys of a text."""
    t = F.col("text")
    return table(spark, d, "chunks").select(
        "chunk_id", F.sha1(tx.squeeze(t)).alias("dedupe_key"), F.md5(F.lower(F.trim(t))).alias("ingest_key"), F.concat(F.lit("clm_"), F.left(F.sha1(t), F.lit(12))).alias("stable_id"), F.left(F.md5(F.left(F.lower(F.trim(t)), F.lit(100))), F.lit(12)).alias("claim_key")
    )


def _chunks_sql(size: int, step: int, least: int) -> str:
    return f"""
WITH w AS (SELECT chunk_id, list_filter(string_split(trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS ws FROM chunks),
c AS (SELECT chunk_id, unnest(range(0, greatest(len(ws), 1), {step})) AS k, ws FROM w)
SELECT chunk_id, CAST(floor(k / {step}) AS INT) AS chunk_idx, array_to_string(ws[k + 1:k + {size}], ' ') AS piece FROM c
WHERE length(array_to_string(ws[k + 1:k + {size}], ' ')) >= {least}"""


def _word_chunks(spark: SparkSession, d: str, size: int, step: int, least: int) -> DataFrame:
    rows = table(spark, d, "chunks").select("chunk_id", F.posexplode(tx.word_chunks(F.col("text"), size, step)).alias("chunk_idx", "piece"))
    return rows.where(F.length("piece") >= least)


@query(_chunks_sql(200, 200, 50))
def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 200 words without overlap, of 50 characters or more."""
    return _word_chunks(spark, d, 200, 200, 50)


@query(_chunks_sql(300, 250, 51))
def chunk_words_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 300 words, a new one every 250, of over 50 characters."""
    return _word_chunks(spark, d, 300, 250, 51)


@query(f"""WITH s AS (SELECT chunk_id, {_SENTENCES.format("text")} AS ss FROM chunks)
SELECT chunk_id, CAST(unnest(range(len(ss))) AS INT) AS pos, unnest(ss) AS sentence FROM s""")
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


def _bad(s):
    low = F.lower(s)
    return (F.length(s) < 40) | s.rlike(r"^\[\d+\]") | (F.length(s) > 500) | tx.matches_any(low, lx.BAD_SENTENCES, lx.BAD_LITERALS) | low.rlike(r"^(abstract|introduction|keywords)")


def _claimlike(s):
    low = F.lower(s)
    cue, numeric, result, method = tx.has_any(low, lx.CLAIM_CUES), low.rlike(lx.NUMERIC_SIGNAL), low.rlike(lx.RESULT_SIGNAL), low.rlike(lx.METHOD_SIGNAL)
    return ~_bad(s) & ((result & (numeric | method | cue)) | (cue & (numeric | method)))


_BAD_SQL = f"(length(s) < 40 OR regexp_matches(s, '^\\[\\d+\\]') OR length(s) > 500 OR {sq.matches_any('lower(s)', lx.BAD_SENTENCES)} OR regexp_matches(lower(s), '^(abstract|introduction|keywords)'))"
_CLAIM_SQL = f"""(NOT {_BAD_SQL} AND (({sq.has_any('lower(s)', lx.CLAIM_CUES)} AND (regexp_matches(lower(s), {sq.q(lx.RESULT_SIGNAL)}) OR regexp_matches(lower(s), {sq.q(lx.METHOD_SIGNAL)}) OR regexp_matches(lower(s), {sq.q(lx.NUMERIC_SIGNAL)})))
 OR (regexp_matches(lower(s), {sq.q(lx.RESULT_SIGNAL)}) AND regexp_matches(lower(s), {sq.q(lx.METHOD_SIGNAL)})) OR (regexp_matches(lower(s), {sq.q(lx.NUMERIC_SIGNAL)}) AND regexp_matches(lower(s), {sq.q(lx.RESULT_SIGNAL)}))))"""


@query(f"""WITH x AS (SELECT chunk_id, unnest({_SENTENCES.format("text")}) AS s FROM chunks)
SELECT chunk_id, count(*) AS n_sentences, sum(CAST({_BAD_SQL} AS INT))::BIGINT AS n_bad, sum(CAST({_CLAIM_SQL} AS INT))::BIGINT AS n_claims FROM x GROUP BY chunk_id""")
def claim_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences, junk and claim-like sentences of each chunk, counted in the row."""
    ss = F.col("ss")
    rows = table(spark, d, "chunks").select("chunk_id", tx.sentences(F.col("text")).alias("ss")).where(F.size("ss") > 0)
    n = lambda x: F.size(x).cast("long")
    return rows.select("chunk_id", n(ss).alias("n_sentences"), n(F.filter(ss, _bad)).alias("n_bad"), n(F.filter(ss, _claimlike)).alias("n_claims"))


@query(f"""WITH x AS (SELECT chunk_id, unnest(range(len(ss))) AS pos, unnest(ss) AS s FROM (SELECT chunk_id, {_SENTENCES.format("text")} AS ss FROM chunks)),
c AS (SELECT chunk_id, s, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS rn FROM x WHERE {_CLAIM_SQL})
SELECT chunk_id, rn AS claim_no, s AS claim_text, 'clm_' || left(sha1(s), 12) AS claim_id FROM c WHERE rn <= 5""")
def extract_claims(spark: SparkSession, d: str) -> DataFrame:
    """Up to five claim statements of each chunk, in order, with stable ids; chosen in the row, so nothing is shuffled."""
    first = F.slice(F.filter(tx.sentences(F.col("text")), _claimlike), 1, 5)
    rows = table(spark, d, "chunks").select("chunk_id", F.posexplode(first).alias("pos", "claim_text"))
    return rows.select("chunk_id", (F.col("pos") + 1).cast("long").alias("claim_no"), "claim_text", F.concat(F.lit("clm_"), F.left(F.sha1("claim_text"), F.lit(12))).alias("claim_id"))


@query(f"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, {sq.q(lx.EQUATION)}, ['lhs', 'rhs'])) AS e FROM (SELECT doc_id, text FROM documents))
SELECT doc_id, trim(e.lhs) AS lhs, trim(e.rhs) AS rhs FROM x""".replace("unnest(regexp_extract_all(text, " + sq.q(lx.EQUATION) + ", ['lhs', 'rhs'])) AS e", f"unnest(list_zip(regexp_extract_all(text, {sq.q(lx.EQUATION)}, 1), regexp_extract_all(text, {sq.q(lx.EQUATION)}, 2))) AS e").replace("e.lhs", "e[1]").replace("e.rhs", "e[2]"))
def find_equations(spark: SparkSession, d: str) -> DataFrame:
    """Left and right sides of ``lhs = rhs`` in documents."""
    return table(spark, d, "documents").select("doc_id", F.inline(tx.equations(F.col("text"), lx.EQUATION)))


def _symbols_sql(t: str) -> str:
    """Distinct identifiers of a text but common words; each but the first follows a mark or a blank."""
    return f"list_distinct(list_filter(regexp_extract_all(regexp_replace({t}, '([^\\p{{L}}\\p{{N}}\\p{{M}}_])', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])([A-Za-z][A-Za-z0-9_]*)(?:$|[^\\p{{L}}\\p{{N}}\\p{{M}}_])', 1), lambda s: NOT list_contains([{', '.join(map(sq.q, lx.NO_SYMBOLS))}], lower(s))))"


def _symbols(c):
    stop = F.array(*map(F.lit, lx.NO_SYMBOLS))
    found = F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}\p{M}_])([A-Za-z][A-Za-z0-9_]*)(?![\p{L}\p{N}\p{M}_])"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda s: ~F.array_contains(stop, F.lower(s))))


@query(f"""WITH x AS (SELECT doc_id, {_symbols_sql("text")} AS ss FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(ss)::INT AS n_symbols, array_to_string(list_sort(ss), ' ') AS symbols FROM x""")
def find_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Distinct identifiers of documents but common words and functions, as a claim's symbols are found."""
    found = _symbols(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(found).alias("n_symbols"), F.array_join(F.array_sort(found), " ").alias("symbols"))


@query(f"""WITH x AS (SELECT chunk_id, {_SENTENCES.format("text")} AS ss FROM chunks)
SELECT chunk_id, len(list_filter(ss, lambda s: {sq.has_any("lower(s)", lx.ASSUME_WORDS)}))::INT AS n_assumptions, len(list_filter(ss, lambda s: {sq.has_any("lower(s)", lx.CONDITION_WORDS)}))::INT AS n_conditions,
 coalesce(left(list_filter(ss, lambda s: {sq.has_any("lower(s)", lx.CONDITION_WORDS)})[1], 240), '') AS first_condition FROM x""")
def assumptions_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with assumption and condition cues."""
    ss = tx.sentences(F.col("text"))
    assume = F.filter(ss, lambda s: tx.has_any(F.lower(s), lx.ASSUME_WORDS))
    conditions = F.filter(ss, lambda s: tx.has_any(F.lower(s), lx.CONDITION_WORDS))
    return table(spark, d, "chunks").select("chunk_id", F.size(assume).alias("n_assumptions"), F.size(conditions).alias("n_conditions"), F.coalesce(F.left(F.get(conditions, 0), F.lit(240)), F.lit("")).alias("first_condition"))


@query(f"""SELECT chunk_id, {sq.best_bucket(sq.low("text"), lx.DIMENSIONS, "general")} AS dimension, {sq.count_of(sq.low("text"), [w for ws in lx.DIMENSIONS.values() for w in ws])} AS n_hits FROM chunks""")
def classify_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Research dimension with most keywords; the earlier one of a tie."""
    t = tx.low("text")
    return table(spark, d, "chunks").select("chunk_id", tx.best_bucket(t, lx.DIMENSIONS, "general").alias("dimension"), tx.count_of(t, [w for ws in lx.DIMENSIONS.values() for w in ws]).alias("n_hits"))


_TOPICS = {"climate": ("runoff", "albedo", "permafrost", "methane", "aerosol", "drought"), "economics": ("wage", "subsidy", "inflation", "credit", "tax"), "robotics": ("grasping", "locomotion", "actuator", "swarm", "calibration"), "medicine": ("relapse", "readmission", "biomarker", "perfusion", "adherence"), "ml_ai": ("attention", "embedding", "distillation", "retrieval", "fine-tuning")}


@query(f"""SELECT doc_id, {sq.best_bucket(sq.low("title || ' ' || coalesce(text, '')"), _TOPICS, "general")} AS topic, CAST({sq.count_of(sq.low("title || ' ' || coalesce(text, '')"), [w for ws in _TOPICS.values() for w in ws])} >= 2 AS BOOLEAN) AS is_relevant FROM documents""")
def detect_domain(spark: SparkSession, d: str) -> DataFrame:
    """Domain by keywords of title and text, and whether two keywords or more are there."""
    t = tx.low(F.concat(F.col("title"), F.lit(" "), F.coalesce("text", F.lit(""))))
    return table(spark, d, "documents").select("doc_id", tx.best_bucket(t, _TOPICS, "general").alias("topic"), (tx.count_of(t, [w for ws in _TOPICS.values() for w in ws]) >= 2).alias("is_relevant"))


@query(f"""SELECT id, CAST(length(n) < 4 OR len(list_filter(string_split(n, ' '), lambda w: NOT list_contains([{", ".join(map(sq.q, lx.NOISE_WORDS))}], w))) = 0 OR list_contains([{", ".join(map(sq.q, lx.GENERIC_OPENINGS))}], split_part(n, ' ', 1)) AS BOOLEAN) AS is_noise_concept,
 CAST(length(n) < 4 OR n LIKE 'the %' OR n LIKE 'this %' OR n LIKE 'our %' OR n LIKE 'a %' OR n LIKE 'an %' OR {sq.has_any("n", lx.NOISE_PHRASES)} OR len(string_split(n, ' ')) > 8 AS BOOLEAN) AS is_artifact,
 {sq.has_any(sq.low("concat_ws(' ', subject, predicate, object)"), lx.OBSERVATION_NOISE)} AS is_noise_observation
FROM (SELECT *, trim({sq.low("subject")}) AS n FROM observations)""")
def noise_tests(spark: SparkSession, d: str) -> DataFrame:
    """Noise tests of observation subjects and whole observations."""
    n = F.trim(tx.low("subject"))
    ws = F.split(n, " ")
    noise = F.array(*map(F.lit, lx.NOISE_WORDS))
    generic = (F.length(n) < 4) | (F.size(F.filter(ws, lambda w: ~F.array_contains(noise, w))) == 0) | F.get(ws, 0).isin(*lx.GENERIC_OPENINGS)
    artifact = (F.length(n) < 4) | n.startswith("the ") | n.startswith("this ") | n.startswith("our ") | n.startswith("a ") | n.startswith("an ") | tx.has_any(n, lx.NOISE_PHRASES) | (F.size(ws) > 8)
    return table(spark, d, "observations").select("id", generic.alias("is_noise_concept"), artifact.alias("is_artifact"), tx.has_any(tx.low(F.concat_ws(" ", "subject", "predicate", "object")), lx.OBSERVATION_NOISE).alias("is_noise_observation"))


@query("""SELECT id, trim(regexp_replace(regexp_replace(lower(trim(coalesce(subject, ''))), '[-_/]', ' ', 'g'), '[\\s\\x0B]+', ' ', 'g'), ' ') AS subject_norm FROM observations""")
def normalise_names(spark: SparkSession, d: str) -> DataFrame:
    """Concept names compared by lower case, with separators as blanks."""
    return table(spark, d, "observations").select("id", F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce("subject", F.lit("")))), "[-_/]", " "), r"\s+", " ")).alias("subject_norm"))


@query(f"""SELECT chunk_id, {sq.first_alias(sq.low("text"), lx.METHOD_ALIASES)} AS method, {sq.first_alias(sq.low("text"), lx.METRIC_ALIASES)} AS metric FROM chunks""")
def method_metric(spark: SparkSession, d: str) -> DataFrame:
    """First method and metric whose alias a chunk contains."""
    t = tx.low("text")
    return table(spark, d, "chunks").select("chunk_id", tx.first_alias(t, lx.METHOD_ALIASES).alias("method"), tx.first_alias(t, lx.METRIC_ALIASES).alias("metric"))


#: Concept words of the test tables, longest first, for concept lookup and triples.
_METHODS = {"adversarial attention": "AdversarialAttention", "sparse attention": "SparseAttention", "recurrent retrieval": "RecurrentRetrieval", "hierarchical distillation": "HierarchicalDistillation", "working memory": "WorkingMemory", "plasticity": "Plasticity", "attention": "Attention", "retrieval": "Retrieval"}
_METRICS = {"inference latency": "InferenceLatency", "memory footprint": "MemoryFootprint", "gradient noise": "GradientNoise", "latency": "Latency", "variance": "Variance", "yield": "Yield", "rate": "Rate"}


def _triples_sql(t: str) -> str:
    m, k = sq.first_alias(t, _METHODS), sq.first_alias(t, _METRICS)
    reduc = [v for v in lx.IMPROVE_VERBS]
    first = "CASE " + " ".join(f"WHEN contains({t}, {sq.q(v)}) THEN {sq.q('reduces' if 'reduc' in v or 'lower' in v else 'improves')}" for v in reduc) + " END"
    return f"""
WITH x AS (SELECT chunk_id, {m} AS m, {k} AS k, {first} AS imp, {sq.has_any(t, lx.TRADEOFF_VERBS)} AS tr FROM chunks),
y AS (SELECT chunk_id, m AS subject, CASE WHEN k IS NULL THEN 'improves' ELSE imp END AS relation, coalesce(k, 'TransformerEfficiency') AS object FROM x WHERE m IS NOT NULL AND imp IS NOT NULL
UNION ALL SELECT chunk_id, m, 'has_tradeoff', coalesce(k, 'GeneralLimitation') FROM x WHERE m IS NOT NULL AND tr
UNION ALL SELECT chunk_id, m, 'related_to', k FROM x WHERE m IS NOT NULL AND imp IS NULL AND NOT tr AND k IS NOT NULL)
SELECT * FROM y"""


@query(_triples_sql(sq.low("text")))
def extract_triples(spark: SparkSession, d: str) -> DataFrame:
    """Subject-relation-object triples of chunks from method, metric and verb cues."""
    t = tx.low("text")
    m, k = tx.first_alias(t, _METHODS), tx.first_alias(t, _METRICS)
    imp = None
    for v in lx.IMPROVE_VERBS:
        kind = "reduces" if "reduc" in v or "lower" in v else "improves"
        imp = F.when(t.contains(v), kind) if imp is None else imp.when(t.contains(v), kind)
    x = table(spark, d, "chunks").select("chunk_id", m.alias("m"), k.alias("k"), imp.alias("imp"), tx.has_any(t, lx.TRADEOFF_VERBS).alias("tr")).where("m is not null")
    triple = lambda rel, obj: F.struct(F.col("m").alias("subject"), rel.alias("relation"), obj.alias("object"))
    found = F.array(
        F.when(F.col("imp").isNotNull(), triple(F.when(F.col("k").isNull(), "improves").otherwise(F.col("imp")), F.coalesce("k", F.lit("TransformerEfficiency")))),
        F.when(F.col("tr"), triple(F.lit("has_tradeoff"), F.coalesce("k", F.lit("GeneralLimitation")))),
        F.when(F.col("imp").isNull() & ~F.col("tr") & F.col("k").isNotNull(), triple(F.lit("related_to"), F.col("k"))),
    )
    return x.select("chunk_id", F.explode(F.filter(found, lambda s: s.isNotNull())).alias("s")).select("chunk_id", "s.subject", "s.relation", "s.object")


_KEYS = sorted([*_METHODS, *_METRICS], key=lambda k: (-len(k), k))
_ALL = {k: (_METHODS | _METRICS)[k] for k in _KEYS}


@query(f"""WITH x AS (SELECT id, list_filter([{", ".join(f"CASE WHEN contains(lower(query), {sq.q(k)}) THEN {sq.q(_ALL[k])} END" for k in _KEYS)}], lambda v: v IS NOT NULL) AS found FROM training_examples)
SELECT id, len(found[1:6])::INT AS n_concepts, coalesce(array_to_string(found[1:6], '|'), '') AS concepts FROM x""")
def concept_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Up to six concepts of a query, longest keyword first."""
    t = F.lower("query")
    found = F.slice(F.filter(F.array(*(F.when(t.contains(k), _ALL[k]) for k in _KEYS)), lambda v: v.isNotNull()), 1, 6)
    return table(spark, d, "training_examples").select("id", F.size(found).alias("n_concepts"), F.array_join(found, "|").alias("concepts"))


def _causal_sql() -> str:
    parts = []
    for rel, ps in lx.CAUSAL_PATTERNS.items():
        hit = "CASE " + " ".join(f"WHEN contains(b, {sq.q(p)}) THEN {sq.q(p)}" for p in ps) + " END"
        parts.append(f"SELECT id, concept_name, belief_text, confidence, supporting_count, {sq.q(rel)} AS relation, {hit} AS p FROM (SELECT *, lower(belief_text) AS b FROM beliefs WHERE supporting_count >= 1)")
    return f"""WITH x AS ({" UNION ALL ".join(parts)}),
y AS (SELECT id, concept_name AS source, relation, left(trim(split_part(split_part(trim(substr(belief_text, strpos(lower(belief_text), p) + length(p)), ' '), '.', 1), ',', 1), ' '), 100) AS target, least(0.95, confidence + 0.1) AS confidence FROM x WHERE p IS NOT NULL)
SELECT id, source, relation, target, round(confidence, 6) AS confidence FROM y WHERE length(target) > 3 AND length(target) < 100"""


@query(_causal_sql())
def causal_from_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """Causal relations stated in beliefs: one row for each belief and relation with a stating word."""
    b = table(spark, d, "beliefs").where("supporting_count >= 1")
    t = F.lower("belief_text")
    hits = []
    for rel, ps in lx.CAUSAL_PATTERNS.items():
        p = None
        for w in ps:
            p = F.when(t.contains(w), w) if p is None else p.when(t.contains(w), w)
        hits.append(F.struct(F.lit(rel).alias("relation"), p.alias("p")))
    x = b.select("id", "concept_name", "belief_text", "confidence", F.explode(F.array(*hits)).alias("h")).where("h.p is not null")
    rest = F.trim(F.expr("substring(belief_text, locate(h.p, lower(belief_text)) + length(h.p))"))
    target = F.left(F.trim(F.split_part(F.split_part(rest, F.lit("."), F.lit(1)), F.lit(","), F.lit(1))), F.lit(100))
    out = x.select("id", F.col("concept_name").alias("source"), "h.relation", target.alias("target"), F.round(F.least(F.lit(0.95), F.col("confidence") + 0.1), 6).alias("confidence"))
    return out.where((F.length("target") > 3) & (F.length("target") < 100))


_NEG = sq.has_any("lower(trim(predicate))", lx.NEGATION_PREDICATES)
BELIEFS_SQL = f"""SELECT id, trim(subject) AS concept, left(trim(subject) || CASE WHEN coalesce(negated, false) OR {_NEG} THEN ' does not ' ELSE ' ' END || trim(predicate) || ' ' || trim(object) || CASE WHEN trim(coalesce(conditions, '')) <> '' THEN ' when ' || trim(conditions) ELSE '' END, 300) AS belief,
 CASE WHEN coalesce(negated, false) OR {_NEG} THEN 'contradicts' ELSE 'supports' END AS obs_type, coalesce(confidence, 0.75) AS confidence, domain FROM observations
WHERE trim(coalesce(subject, '')) <> '' AND trim(coalesce(predicate, '')) <> '' AND trim(coalesce(object, '')) <> ''"""


def beliefs_of(obs: DataFrame) -> DataFrame:
    """Belief sentences and polarity of observations with subject, predicate and object."""
    s, p, o, c = (F.trim(F.coalesce(x, F.lit(""))) for x in ("subject", "predicate", "object", "conditions"))
    negated = F.coalesce("negated", F.lit(False)) | tx.has_any(F.lower(p), lx.NEGATION_PREDICATES)
    belief = F.left(F.concat(s, F.when(negated, " does not ").otherwise(" "), p, F.lit(" "), o, F.when(c != "", F.concat(F.lit(" when "), c)).otherwise("")), F.lit(300))
    return obs.where((s != "") & (p != "") & (o != "")).select("id", s.alias("concept"), belief.alias("belief"), F.when(negated, "contradicts").otherwise("supports").alias("obs_type"), F.coalesce("confidence", F.lit(0.75)).alias("confidence"), "domain")


@query(BELIEFS_SQL)
def beliefs_from_observations(spark: SparkSession, d: str) -> DataFrame:
    return beliefs_of(table(spark, d, "observations"))


@query(f"""SELECT chunk_id, {sq.matches_any(sq.low("text"), lx.NEGATIONS)} AS is_negated,
 round({sq.clamp(f"{sq.yes('num', 0.45)} + {sq.yes('met', 0.45)} + {sq.yes('theo', 0.55)} - {sq.yes('def AND NOT theo', 0.25)} - {sq.yes('length(text) < 180', 0.10)}", 0.15, 1.0)}, 6) AS quality_a,
 round({sq.clamp(f"{sq.yes('num', 0.45)} + {sq.yes('met', 0.45)} - {sq.yes('def', 0.25)} - {sq.yes('length(text) < 220', 0.15)}", 0.0, 1.0)}, 6) AS quality_b
FROM (SELECT chunk_id, text, regexp_matches(t, {sq.q("(?i)" + lx.EVIDENCE_NUMERIC)}) AS num, regexp_matches(t, {sq.q("(?i)" + lx.EVIDENCE_METHOD)}) AS met, regexp_matches(t, {sq.q("(?i)" + lx.EVIDENCE_DEFINITION)}) AS def, regexp_matches(t, {sq.q("(?i)" + lx.EVIDENCE_THEORY)}) AS theo FROM (SELECT chunk_id, text, regexp_replace(text, '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}\\p{{M}}σö]', 'q', 'g') AS t FROM chunks))""")
def evidence_quality(spark: SparkSession, d: str) -> DataFrame:
    """Negation and the two evidence scores of chunks."""
    t = F.col("text")
    # a word ends where no letter or digit of any script follows; SQL's engine knows ASCII only, so there other letters stand as q
    num, met, definition, theory = (t.rlike("(?i)" + p) for p in (lx.EVIDENCE_NUMERIC, lx.EVIDENCE_METHOD, lx.EVIDENCE_DEFINITION, lx.EVIDENCE_THEORY))
    a = tx.yes(num, 0.45) + tx.yes(met, 0.45) + tx.yes(theory, 0.55) - tx.yes(definition & ~theory, 0.25) - tx.yes(F.length(t) < 180, 0.10)
    b = tx.yes(num, 0.45) + tx.yes(met, 0.45) - tx.yes(definition, 0.25) - tx.yes(F.length(t) < 220, 0.15)
    return table(spark, d, "chunks").select("chunk_id", tx.matches_any(F.lower(t), lx.NEGATIONS, lx.NEGATION_LITERALS).alias("is_negated"), F.round(tx.clamp(a, 0.15, 1.0), 6).alias("quality_a"), F.round(tx.clamp(b, 0.0, 1.0), 6).alias("quality_b"))


@query(f"""SELECT chunk_id, CASE WHEN contains({sq.low("source")}, 'wikipedia') THEN 0.55 WHEN contains({sq.low("source")}, 'crossref') THEN 0.65 ELSE 1.0 END::DOUBLE AS source_weight,
 round({sq.clamp(f"0.5 + {sq.yes(sq.has_any(sq.low('source'), lx.TOP_VENUES) + ' OR ' + sq.has_any(sq.low('paper_title'), lx.TOP_VENUES), 0.2)} + {sq.yes(sq.has_any(sq.low('paper_title'), lx.LANDMARKS), 0.15)} - {sq.yes('length(' + sq.low('paper_title') + ') > 100', 0.05)}", 0.1, 1.0)}, 6) AS paper_quality FROM chunks""")
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    """Weight of a source and quality of a paper by its title and venue."""
    s, t = tx.low("source"), tx.low("paper_title")
    quality = F.lit(0.5) + tx.yes(tx.has_any(s, lx.TOP_VENUES) | tx.has_any(t, lx.TOP_VENUES), 0.2) + tx.yes(tx.has_any(t, lx.LANDMARKS), 0.15) - tx.yes(F.length(t) > 100, 0.05)
    return table(spark, d, "chunks").select("chunk_id", F.when(s.contains("wikipedia"), 0.55).when(s.contains("crossref"), 0.65).otherwise(1.0).alias("source_weight"), F.round(tx.clamp(quality, 0.1, 1.0), 6).alias("paper_quality"))


def _kw(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({sq.low(c)}, '[a-z]{{4,}}'), lambda w: NOT list_contains([{', '.join(map(sq.q, lx.STOP_WORDS))}], w)))"


@query(f"""WITH x AS (SELECT id, {_kw("query")} AS a, {_kw("response")} AS b FROM training_examples)
SELECT id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM x""")
def keyword_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of query and response by words of four letters or more."""
    stop = F.array(*map(F.lit, lx.STOP_WORDS))
    kw = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(tx.low(c), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~F.array_contains(stop, w)))
    return table(spark, d, "training_examples").select("id", F.round(tx.jaccard(kw("query"), kw("response")), 6).alias("similarity"))


@query("""SELECT id, coalesce(try_cast(regexp_extract(lower(response), 'confidence[:\\s]+([0-9.]*[0-9])', 1) AS DOUBLE), -1.0) AS stated_confidence,
 CASE WHEN contains(lower(response), 'strong support') THEN 'strong' WHEN contains(lower(response), 'refuted') THEN 'refuted' WHEN contains(lower(response), 'no link') THEN 'weak' ELSE 'unknown' END AS stated_verdict,
 round((CASE WHEN length(response) > 200 THEN 0.2 ELSE 0 END) + (CASE WHEN coalesce(trim(verdict), '') NOT IN ('', 'ERROR') THEN 0.2 ELSE 0 END) + (CASE WHEN confidence > 0 THEN 0.2 ELSE 0 END) + (CASE WHEN regexp_matches(response, '\\[\\d+\\]') THEN 0.2 ELSE 0 END) + (CASE WHEN length(chunks_json) > 2 THEN 0.2 ELSE 0 END), 6) AS quality FROM training_examples""")
def parse_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Confidence and verdict stated in a response, and a quality score of five tests."""
    r = F.col("response")
    low = F.lower(r)
    stated = F.coalesce(F.regexp_extract(low, r"confidence[:\s]+([0-9.]*[0-9])", 1).try_cast("double"), F.lit(-1.0))
    verdict = F.when(low.contains("strong support"), "strong").when(low.contains("refuted"), "refuted").when(low.contains("no link"), "weak").otherwise("unknown")
    quality = tx.yes(F.length(r) > 200, 0.2) + tx.yes(~F.coalesce(F.trim("verdict"), F.lit("")).isin("", "ERROR"), 0.2) + tx.yes(F.col("confidence") > 0, 0.2) + tx.yes(r.rlike(r"\[\d+\]"), 0.2) + tx.yes(F.length("chunks_json") > 2, 0.2)
    return table(spark, d, "training_examples").select("id", stated.alias("stated_confidence"), verdict.alias("stated_verdict"), F.round(quality, 6).alias("quality"))


@query("""SELECT chunk_id, CASE WHEN regexp_matches(coalesce(paper_title, ''), '^[a-z]') THEN upper(left(split_part(paper_title, '.', 1), 1)) || substr(split_part(paper_title, '.', 1), 2) || '...' ELSE left(coalesce(paper_title, ''), 100) END AS clean_title FROM chunks""")
def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles that begin in lower case become their first sentence, capitalised; others are cut."""
    t = F.coalesce("paper_title", F.lit(""))
    first = F.split_part(t, F.lit("."), F.lit(1))
    return table(spark, d, "chunks").select("chunk_id", F.when(t.rlike("^[a-z]"), F.concat(F.upper(F.left(first, F.lit(1))), F.substring(first, 2, 10000), F.lit("..."))).otherwise(F.left(t, F.lit(100))).alias("clean_title"))


def _template_sql(a: str, r: str, b: str) -> str:
    fill = lambda t: " || ".join({"{a}": a, "{b}": b, "{rel}": r}.get(x, sq.q(x)) for x in re.split(r"(\{\w+\})", t) if x)
    return f"CASE {r} " + " ".join(f"WHEN {sq.q(k)} THEN {fill(t)}" for k, t in lx.RELATION_TEMPLATES.items()) + f" ELSE {fill(lx.OTHER_TEMPLATE)} END"


def readable(a, r, b):
    """A relation between two concepts in words."""

    def fill(t: str):
        return F.concat(*({"{a}": a, "{b}": b, "{rel}": r}.get(x, F.lit(x)) for x in re.split(r"(\{\w+\})", t) if x))

    out = None
    for k, t in lx.RELATION_TEMPLATES.items():
        out = F.when(r == k, fill(t)) if out is None else out.when(r == k, fill(t))
    return out.otherwise(fill(lx.OTHER_TEMPLATE))


@query(f"""WITH h AS (SELECT id, source_concept || ' --' || relation_type || '--> ' || target_concept AS h, {_template_sql("source_concept", "lower(relation_type)", "target_concept")} AS readable FROM causal_relations)
SELECT id, regexp_replace(h, '--\\[?([^\\]>-]+)\\]?-->', '→') AS arrow_text, trim(regexp_extract(h, '(?s)^(.*?) --', 1)) AS s, trim(regexp_extract(h, '(?s)--> (.*)$', 1)) AS o, readable, CAST(length(readable) >= 10 AND NOT {sq.matches_any("lower(readable)", lx.BAD_HYPOTHESES)} AS BOOLEAN) AS is_valid FROM h""")
def parse_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """Hypotheses written as ``a --r--> b`` parsed back, with arrows, in readable words, and whether these are valid."""
    h = F.concat("source_concept", F.lit(" --"), "relation_type", F.lit("--> "), "target_concept")
    text = readable(F.col("source_concept"), F.lower("relation_type"), F.col("target_concept"))
    rows = table(spark, d, "causal_relations").select("id", F.regexp_replace(h, r"--\[?([^\]>-]+)\]?-->", "→").alias("arrow_text"), F.trim(F.regexp_extract(h, r"(?s)^(.*?) --", 1)).alias("s"), F.trim(F.regexp_extract(h, r"(?s)--> (.*)$", 1)).alias("o"), text.alias("readable"))
    return rows.withColumn("is_valid", (F.length("readable") >= 10) & ~tx.matches_any(F.lower("readable"), lx.BAD_HYPOTHESES))


@query("""SELECT chunk_id, coalesce(try_cast(json_extract_string(CASE WHEN json_valid(meta_json) THEN meta_json END, '$.year') AS INT), -1) AS year, json_extract_string(CASE WHEN json_valid(meta_json) THEN meta_json END, '$.lang') AS lang, CAST(coalesce(json_valid(meta_json), false) AS BOOLEAN) AS is_valid FROM chunks""")
def clean_json(spark: SparkSession, d: str) -> DataFrame:
    """Fields of JSON text, tolerating broken and missing documents."""
    v = F.try_parse_json("meta_json")
    return table(spark, d, "chunks").select("chunk_id", F.coalesce(F.try_variant_get(v, "$.year", "int"), F.lit(-1)).alias("year"), F.try_variant_get(v, "$.lang", "string").alias("lang"), v.isNotNull().alias("is_valid"))


@query("""WITH w AS (SELECT unnest(string_split(lower(squeezed), ' ')) AS w FROM (SELECT trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g'), ' ') AS squeezed FROM documents WHERE text IS NOT NULL)),
p AS (SELECT substr(w, i, 2) AS pair FROM (SELECT w, unnest(range(1, greatest(length(w), 1))) AS i FROM w))
SELECT pair, count(*) AS n FROM p WHERE length(pair) = 2 GROUP BY pair""")
def bpe_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of adjacent character pairs inside words: what a pair-merging tokenizer starts from."""
    docs = table(spark, d, "documents").where("text is not null")
    words = docs.select(F.explode(F.split(F.lower(tx.squeeze(F.col("text"))), " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c")).where(F.length("w") >= 2)
    pairs = words.select("c", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("pair"))
    return pairs.groupBy("pair").agg(F.sum("c").alias("n"))


@query("""SELECT id, array_to_string(list_filter(string_split(lower(query), ' '), lambda w: length(w) > 3)[1:6], ' ') AS keywords FROM training_examples""")
def query_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The first six words of a query of over three characters."""
    return table(spark, d, "training_examples").select("id", F.array_join(F.slice(tx.words_over(F.col("query"), 3), 1, 6), " ").alias("keywords"))


@query("""SELECT chunk_id, lower(regexp_extract(text, '(\\d+(?:\\.\\d+)?) percent', 1)) AS first_percent, CASE WHEN contains(lower(text), 'training') THEN 'training' WHEN contains(lower(text), 'inference') THEN 'inference' WHEN contains(lower(text), 'classification') THEN 'classification' END AS task, regexp_extract(lower(text), '\\(n = (\\d+)\\)', 1) AS sample_size FROM chunks""")
def benchmark_context(spark: SparkSession, d: str) -> DataFrame:
    """Setting of a result: first percentage, task and sample size."""
    t = F.lower("text")
    task = F.when(t.contains("training"), "training").when(t.contains("inference"), "inference").when(t.contains("classification"), "classification")
    return table(spark, d, "chunks").select("chunk_id", F.regexp_extract(t, r"(\d+(?:\.\d+)?) percent", 1).alias("first_percent"), task.alias("task"), F.regexp_extract(t, r"\(n = (\d+)\)", 1).alias("sample_size"))


@query("""WITH w AS (SELECT chunk_id, string_split(trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g'), ' '), ' ') AS ws FROM chunks) SELECT chunk_id, array_to_string(ws, ' ') AS rebuilt FROM w""")
def inverted_index_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts rebuilt from inverted indexes (word to positions), the last word of a position winning."""
    src = table(spark, d, "chunks").select("chunk_id", F.posexplode(F.split(tx.squeeze(F.col("text")), " ")).alias("pos", "w"))
    index = src.groupBy("chunk_id", "w").agg(F.collect_list("pos").alias("positions"))
    back = index.select("chunk_id", "w", F.explode("positions").alias("pos"))
    return back.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"]), " ").alias("rebuilt"))
