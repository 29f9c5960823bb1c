"""Queries of claims and of the tests that texts, questions and ideas are put to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataclaim.functions import lexicons as lx
from strataclaim.functions import sqltext as sq
from strataclaim.functions import text as tx
from strataclaim.plans.catalog import query
from strataclaim.plans.textplans import _CLAIM_SQL, _SENTENCES, _bad, _BAD_SQL, _claimlike
from strataclaim.session import table

_LISTS = {"tr": lx.CLAIM_TRANSFORMER, "ph": lx.CLAIM_PHYSICS, "ma": lx.CLAIM_MATH}


def _domain_sql(t: str) -> str:
    tr, ph, ma = (sq.count_of(f"lower({t})", ws) for ws in _LISTS.values())
    return f"CASE WHEN {tr} > 0 AND {tr} >= greatest({ph}, {ma}) THEN 'transformer_efficiency' WHEN {ph} > {ma} THEN 'physics' WHEN {ma} > {ph} THEN 'math' WHEN {ph} > 0 THEN 'mixed' ELSE 'unknown' END"


def claim_domain(c: Column) -> Column:
    """Domain of a claim by the words of three lists it contains; ties of the last two are mixed."""
    counts = tx.once(F.lower(c), lambda t: F.struct(*(tx.count_of(t, ws).alias(n) for n, ws in _LISTS.items())))

    def ladder(n: Column) -> Column:
        tr, ph, ma = n["tr"], n["ph"], n["ma"]
        return F.when((tr > 0) & (tr >= F.greatest(ph, ma)), "transformer_efficiency").when(ph > ma, "physics").when(ma > ph, "math").when(ph > 0, "mixed").otherwise("unknown")

    return tx.once(counts, ladder)


@query(f"SELECT chunk_id, {_domain_sql('text')} AS domain FROM chunks")
def guess_claim_domain(spark: SparkSession, d: str) -> DataFrame:
    """Domain of each chunk taken as a claim."""
    return table(spark, d, "chunks").select("chunk_id", claim_domain(F.col("text")).alias("domain"))


_DEFS = ("(?i)" + lx.DEFINED_AS, "(?i)" + lx.DEFINE_COLON)


def _pairs_sql(pattern: str, by: str) -> str:
    return f"CASE WHEN contains(lower(t), {sq.q('=' if by == ' = ' else 'defin')}) THEN list_transform(list_zip(regexp_extract_all(t, {sq.q(pattern)}, 1), regexp_extract_all(t, {sq.q(pattern)}, 2)), lambda p: trim(p[1]) || {sq.q(by)} || trim(p[2])) ELSE [] END"


_CLAIMS = f"""x AS (SELECT id, {sq.squeeze("body")} AS t FROM src),
y AS (SELECT id, t, {_SENTENCES.format("t")} AS ss FROM x),
z AS (SELECT id, t, ss, {_pairs_sql(lx.EQUATION, " = ")}[1:3] AS eqs, list_concat({_pairs_sql(_DEFS[0], " is defined as ")}, {_pairs_sql(_DEFS[1], " is defined as ")})[1:3] AS defs, list_filter(list_filter(ss, lambda s, i: list_position(ss, s) = i), lambda s: {_CLAIM_SQL})[1:5] AS stats FROM y),
f AS (SELECT *, CASE WHEN len(eqs) + len(defs) + len(stats) = 0 THEN list_filter(ss, lambda s: NOT {_BAD_SQL} AND (regexp_matches(lower(s), {sq.q(lx.RESULT_SIGNAL)}) OR regexp_matches(lower(s), {sq.q(lx.METHOD_SIGNAL)})))[1:1] ELSE [] END AS fall FROM z),
claims AS (SELECT id, t, 'equation' AS kind, unnest(range(1, len(eqs) + 1)) AS no, unnest(eqs) AS claim FROM f UNION ALL SELECT id, t, 'definition', unnest(range(1, len(defs) + 1)), unnest(defs) FROM f
UNION ALL SELECT id, t, 'statement', unnest(range(1, len(stats) + 1)), unnest(stats) FROM f UNION ALL SELECT id, t, 'statement', 1, unnest(fall) FROM f)"""
_CHUNK_CLAIMS = f"WITH src AS (SELECT chunk_id AS id, text AS body FROM chunks), {_CLAIMS}"


def claims_of(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, t, kind, no, claim)``: up to three equations, three definitions and five statements of a text.

    Where there is none of them, the first sentence with a sign of a result or a method stands in. ``t`` is the
    squeezed text. All of it is worked out in the row.
    """
    rows = rows.select(id_col, tx.squeeze(F.col(text_col)).alias("t"))

    def found(pattern: str, by: str) -> Column:
        # a literal that every match has spares most texts the pattern
        some = F.lower("t").contains("defin")
        sides = F.arrays_zip(F.regexp_extract_all("t", F.lit(pattern), F.lit(1)).alias("l"), F.regexp_extract_all("t", F.lit(pattern), F.lit(2)).alias("r"))
        return F.when(some, F.transform(sides, lambda p: F.concat(F.trim(p["l"]), F.lit(by), F.trim(p["r"])))).otherwise(F.array().cast("array<string>"))

    # as elsewhere, a point matches all but a line feed
    definitions = F.concat(*(found("(?d)" + p, " is defined as ") for p in _DEFS))
    # generators keep projections apart, so that nothing is worked out again where it is named again
    apart = lambda df, *cols: df.select(id_col, F.inline(F.array(F.struct(*cols))))
    rows = apart(rows, F.col("t"), tx.sentences(F.col("t")).alias("ss"))
    rows = apart(rows, "t", "ss", F.slice(F.transform(tx.equations(F.col("t"), lx.EQUATION), lambda e: F.concat(e["lhs"], F.lit(" = "), e["rhs"])), 1, 3).alias("eqs"), F.slice(definitions, 1, 3).alias("defs"), F.slice(F.filter(F.array_distinct("ss"), _claimlike), 1, 5).alias("stats"))
    signal = lambda s: ~_bad(s) & (F.lower(s).rlike(lx.RESULT_SIGNAL) | F.lower(s).rlike(lx.METHOD_SIGNAL))
    none = F.size("eqs") + F.size("defs") + F.size("stats") == 0
    rows = rows.withColumn("stats", F.when(none, F.slice(F.filter("ss", signal), 1, 1)).otherwise(F.col("stats")))
    numbered = lambda c, kind: F.transform(c, lambda s, i: F.struct(F.lit(kind).alias("kind"), (i + 1).cast("long").alias("no"), s.alias("claim")))
    kinds = F.concat(numbered("eqs", "equation"), numbered("defs", "definition"), numbered("stats", "statement"))
    return rows.select(id_col, "t", F.explode(kinds).alias("c")).select(id_col, "t", "c.kind", "c.no", "c.claim")


@query(_CHUNK_CLAIMS + f" SELECT id AS chunk_id, kind, no, claim, 'clm_' || left(sha1(claim), 12) AS claim_id, CASE WHEN kind = 'statement' THEN {_domain_sql('claim')} ELSE {_domain_sql('t')} END AS domain FROM claims")
def claims_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Claims of every chunk: equations, definitions and statements, with ids and domains."""
    c = claims_of(table(spark, d, "chunks"), "chunk_id", "text")
    domain = F.when(F.col("kind") == "statement", claim_domain(F.col("claim"))).otherwise(claim_domain(F.col("t")))
    return c.select("chunk_id", "kind", "no", "claim", F.concat(F.lit("clm_"), F.left(F.sha1("claim"), F.lit(12))).alias("claim_id"), domain.alias("domain"))


@query(f"""WITH x AS (SELECT doc_id, {sq.squeeze("text")} AS t FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, list_concat(list_zip(regexp_extract_all(t, {sq.q(_DEFS[0])}, 1), regexp_extract_all(t, {sq.q(_DEFS[0])}, 2)), list_zip(regexp_extract_all(t, {sq.q(_DEFS[1])}, 1), regexp_extract_all(t, {sq.q(_DEFS[1])}, 2))) AS ds FROM x)
SELECT doc_id, len(ds)::INT AS n_definitions, coalesce(trim(ds[1][1]), '') AS term, coalesce(trim(ds[1][2]), '') AS meaning FROM y""")
def find_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Terms that a text defines (``X is defined as Y``, ``define X: Y``), and the first of them."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", tx.squeeze(F.col("text")).alias("t"))
    pairs = lambda p: F.arrays_zip(F.regexp_extract_all("t", F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all("t", F.lit(p), F.lit(2)).alias("b"))
    ds = F.concat(*(pairs("(?d)" + p) for p in _DEFS))
    first = lambda c: F.coalesce(F.trim(F.get(ds, 0)[c]), F.lit(""))
    return rows.select("doc_id", F.size(ds).alias("n_definitions"), first("a").alias("term"), first("b").alias("meaning"))


def _cue_sql(words: tuple[str, ...]) -> str:
    cues = ", ".join(f"list_filter(ss, lambda s: contains(lower(s), {sq.q(w)}))" for w in words)
    return f"list_transform(flatten([{cues}]), lambda s: left(s, 240))"


@query(f"""WITH x AS (SELECT chunk_id, {_SENTENCES.format(sq.squeeze("text"))} AS ss FROM chunks), y AS (SELECT chunk_id, {_cue_sql(lx.ASSUME_WORDS)} AS a, {_cue_sql(lx.CONDITION_WORDS)} AS c FROM x)
SELECT chunk_id, array_to_string(list_filter(a, lambda s, i: list_position(a, s) = i), ' | ') AS assumptions, array_to_string(list_filter(c, lambda s, i: list_position(c, s) = i), ' | ') AS conditions FROM y""")
def assumption_lists(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with each assumption and condition cue, cue by cue, cut to 240 letters, each once."""
    rows = table(spark, d, "chunks").select("chunk_id", tx.sentences(tx.squeeze(F.col("text"))).alias("ss"))

    def grab(words: tuple[str, ...]) -> Column:
        held = lambda w: lambda s: F.lower(s).contains(w)
        parts = [F.filter("ss", held(w)) for w in words]
        return F.array_join(F.array_distinct(F.transform(F.concat(*parts), lambda s: F.left(s, F.lit(240)))), " | ")

    return rows.select("chunk_id", grab(lx.ASSUME_WORDS).alias("assumptions"), grab(lx.CONDITION_WORDS).alias("conditions"))


_FIRST_STAGE = "CASE " + " ".join(f"WHEN {sq.has_any('t', ws)} THEN {sq.q(n)}" for n, ws in lx.IDEA_STAGES.items()) + " ELSE 'Research Direction' END"


@query(f"""WITH q AS (SELECT id, lower(query) AS t FROM training_examples)
SELECT id, {_FIRST_STAGE} AS stage, {sq.best_bucket("t", lx.PROPOSAL_BUCKETS, "unknown")} AS proposal_bucket, {sq.best_bucket("t", {k: [w.lower() for w in ws] for k, ws in lx.HYPOTHESIS_BUCKETS.items()}, "unknown")} AS hypothesis_bucket, CAST({sq.matches_any("t", lx.DEFINITIONISH)} AS BOOLEAN) AS definitionish FROM q""")
def idea_tests(spark: SparkSession, d: str) -> DataFrame:
    """Stage, topic buckets and definition test of every question."""
    t = F.lower("query")
    stage = reduce(lambda c, x: F.when(tx.has_any(t, x[1]), x[0]) if c is None else c.when(tx.has_any(t, x[1]), x[0]), lx.IDEA_STAGES.items(), None).otherwise("Research Direction")
    lower = {k: [w.lower() for w in ws] for k, ws in lx.HYPOTHESIS_BUCKETS.items()}
    return table(spark, d, "training_examples").select("id", stage.alias("stage"), tx.best_bucket(t, lx.PROPOSAL_BUCKETS, "unknown").alias("proposal_bucket"), tx.best_bucket(t, lower, "unknown").alias("hypothesis_bucket"), tx.matches_any(t, lx.DEFINITIONISH).alias("definitionish"))


_STOPS = ", ".join(map(sq.q, lx.QUESTION_STOP_WORDS))
_CLEAN = "list_transform(string_split(t, ' '), lambda w: trim(w, '?.,!'))"


@query(f"""WITH q AS (SELECT id, {sq.squeeze("lower(query)")} AS t FROM training_examples), w AS (SELECT id, {_CLEAN} AS ws FROM q),
k AS (SELECT id, ws, list_filter(ws, lambda w: (upper(w) = w AND length(w) >= 2) OR (length(w) > 4 AND NOT list_contains([{_STOPS}], w)))[1:8] AS ks FROM w)
SELECT id, array_to_string(CASE WHEN len(ks) > 0 THEN ks ELSE list_filter(ws, lambda w: length(w) > 2)[1:4] END, ' ') AS keywords FROM k""")
def search_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of a question for a search by words: figures and long words, eight at most, else four of over two letters."""
    ws = F.transform(F.split(tx.squeeze(F.lower("query")), " "), lambda w: F.trim(w, F.lit("?.,!")))
    stop = F.array(*map(F.lit, lx.QUESTION_STOP_WORDS))
    rows = table(spark, d, "training_examples").select("id", ws.alias("ws"))
    ks = F.slice(F.filter("ws", lambda w: ((F.upper(w) == w) & (F.length(w) >= 2)) | ((F.length(w) > 4) & ~F.array_contains(stop, w))), 1, 8)
    return rows.select("id", F.array_join(F.when(F.size(ks) > 0, ks).otherwise(F.slice(F.filter("ws", lambda w: F.length(w) > 2), 1, 4)), " ").alias("keywords"))


def _first_sql(t: str, cases, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {sq.has_any(t, ws)} THEN {v if isinstance(v, float) else sq.q(v)}" for v, ws in cases) + f" ELSE {default} END"


def _first(t: Column, cases, default) -> Column:
    return reduce(lambda c, x: F.when(tx.has_any(t, x[1]), x[0]) if c is None else c.when(tx.has_any(t, x[1]), x[0]), cases, None).otherwise(default)


@query(f"""WITH r AS (SELECT id, lower(coalesce(response, '')) AS t FROM training_examples), n AS (SELECT id, t, coalesce(try_cast(regexp_extract(t, 'confidence[:\\s]+([0-9.]+)', 1) AS DOUBLE), 0.5) AS said FROM r)
SELECT id, {_first_sql("t", lx.STATED_VERDICTS, "'MODERATE SUPPORT'")} AS verdict, (CASE WHEN said = 0.5 THEN {_first_sql("t", lx.STATED_CONFIDENCE, "0.5")} ELSE said END)::DOUBLE AS confidence, {_first_sql("t", lx.STATED_VERDICTS_PLAIN, "'MODERATE SUPPORT'")} AS plain_verdict, said AS plain_confidence FROM n""")
def stated_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict and confidence that a response states, by both variants."""
    t = F.lower(F.coalesce("response", F.lit("")))
    said = F.coalesce(F.regexp_extract(t, r"confidence[:\s]+([0-9.]+)", 1).try_cast("double"), F.lit(0.5))
    rows = table(spark, d, "training_examples").select("id", t.alias("t"), said.alias("said"))
    t, said = F.col("t"), F.col("said")
    confidence = F.when(said == 0.5, _first(t, lx.STATED_CONFIDENCE, 0.5)).otherwise(said)
    return rows.select("id", _first(t, lx.STATED_VERDICTS, "MODERATE SUPPORT").alias("verdict"), confidence.alias("confidence"), _first(t, lx.STATED_VERDICTS_PLAIN, "MODERATE SUPPORT").alias("plain_verdict"), said.alias("plain_confidence"))


_SEQ = (r"(\d+[k])\s*(?:token|sequence|context|seq|len)", r"(?:sequence|context)\s+length[s]?\s+(?:of\s+)?(\d+[k]?)")
_SIZE = r"(\d+(?:\.\d+)?[bm])\s*(?:parameter|param)"


def _named_sql(t: str, names) -> str:
    return "CASE " + " ".join(f"WHEN contains({t}, {sq.q(n)}) THEN {sq.q(v)}" for n, v in names) + " END"


def _setting_sql(t: str) -> str:
    return f"""{_named_sql(t, [(h, h.upper().replace(" ", "-")) for h in lx.HARDWARE_NAMES])} AS hardware, coalesce(nullif(regexp_extract({t}, {sq.q(_SEQ[0])}, 1), ''), nullif(regexp_extract({t}, {sq.q(_SEQ[1])}, 1), '')) AS sequence,
 {_named_sql(t, [(k, k) for k in lx.TASK_NAMES])} AS task, upper(nullif(regexp_extract({t}, {sq.q(_SIZE)}, 1), '')) || ' params' AS model_size"""


def _setting(t: Column) -> list[Column]:
    named = lambda names: reduce(lambda c, x: F.when(t.contains(x[0]), x[1]) if c is None else c.when(t.contains(x[0]), x[1]), names, None)
    part = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return [named([(h, h.upper().replace(" ", "-")) for h in lx.HARDWARE_NAMES]).alias("hardware"), F.coalesce(*map(part, _SEQ)).alias("sequence"), named([(k, k) for k in lx.TASK_NAMES]).alias("task"), F.concat(F.upper(part(_SIZE)), F.lit(" params")).alias("model_size")]


@query(f"SELECT chunk_id, {_setting_sql('lower(text)')} FROM chunks")
def benchmark_settings(spark: SparkSession, d: str) -> DataFrame:
    """Hardware, sequence length, task and model size that a chunk names."""
    return table(spark, d, "chunks").select("chunk_id", *_setting(F.lower("text")))


def _domains_sql(title: str, both: str) -> str:
    return "CASE " + " ".join(f"WHEN {sq.has_any(title, ws)} THEN {sq.q(k)}" for k, ws in lx.TITLE_SIGNALS.items()) + " " + " ".join(f"WHEN {sq.count_of(both, ws)} >= 2 THEN {sq.q(k)}" for k, ws in lx.TEXT_SIGNALS.items()) + " ELSE 'ml_ai' END"


@query(f"""WITH x AS (SELECT doc_id, {sq.low("title")} AS ti, {sq.low("text")} || ' ' || {sq.low("title")} AS t, {sq.low("title")} || ' ' || {sq.low("text")} AS both_ FROM documents)
SELECT doc_id, {_domains_sql("ti", "t")} AS domain, CAST({sq.count_of("both_", lx.RELEVANT_WORDS)} >= 2 AS BOOLEAN) AS is_relevant FROM x""")
def ingest_domain(spark: SparkSession, d: str) -> DataFrame:
    """Domain of a paper by its title's signals, else by two of its text's, and whether it is relevant."""
    ti, tt = tx.low("title"), tx.low("text")
    rows = table(spark, d, "documents").select("doc_id", ti.alias("ti"), F.concat(tt, F.lit(" "), ti).alias("t"), F.concat(ti, F.lit(" "), tt).alias("b"))
    domain = None
    for k, ws in lx.TITLE_SIGNALS.items():
        domain = F.when(tx.has_any(F.col("ti"), ws), k) if domain is None else domain.when(tx.has_any(F.col("ti"), ws), k)
    for k, ws in lx.TEXT_SIGNALS.items():
        domain = domain.when(tx.count_of(F.col("t"), ws) >= 2, k)
    return rows.select("doc_id", domain.otherwise("ml_ai").alias("domain"), (tx.count_of(F.col("b"), lx.RELEVANT_WORDS) >= 2).alias("is_relevant"))


@query("""WITH f AS (SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN '```json' || chr(10) || coalesce(meta_json, '') || chr(10) || '```' WHEN chunk_id % 3 = 1 THEN 'Here it is: ```' || coalesce(meta_json, '') || '``` done' ELSE coalesce(meta_json, '') END AS raw FROM chunks),
p AS (SELECT chunk_id, raw, list_filter(list_transform(string_split(raw, '```'), lambda p: CASE WHEN starts_with(trim(p, E' \\t\\n\\r'), 'json') THEN trim(substr(trim(p, E' \\t\\n\\r'), 5), E' \\t\\n\\r') ELSE trim(p, E' \\t\\n\\r') END), lambda p: (starts_with(p, '{') OR starts_with(p, '[')) AND json_valid(p)) AS ps FROM f),
j AS (SELECT chunk_id, CASE WHEN contains(raw, '```') THEN ps[1] WHEN json_valid(trim(raw, E' \\t\\n\\r')) THEN raw END AS j FROM p) SELECT chunk_id, CAST(j IS NOT NULL AS BOOLEAN) AS parsed, coalesce(try_cast(json_extract_string(j, '$.year') AS INT), -1) AS year FROM j""")
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON of model answers, in fences or bare: the first part that is an object or a list and can be read."""
    third, meta = F.pmod("chunk_id", F.lit(3)), F.coalesce("meta_json", F.lit(""))
    raw = F.when(third == 0, F.concat(F.lit("```json\n"), meta, F.lit("\n```"))).when(third == 1, F.concat(F.lit("Here it is: ```"), meta, F.lit("``` done"))).otherwise(meta)
    bare = lambda c: F.trim(c, F.lit(" \t\n\r"))
    parts = F.transform(F.split("raw", "```"), lambda p: F.when(bare(p).startswith("json"), bare(F.substring(bare(p), 5, 2**30))).otherwise(bare(p)))
    good = F.filter(parts, lambda p: (p.startswith("{") | p.startswith("[")) & F.try_parse_json(p).isNotNull())
    rows = table(spark, d, "chunks").select("chunk_id", raw.alias("raw"))
    rows = rows.select("chunk_id", F.try_parse_json(F.when(F.col("raw").contains("```"), F.get(good, 0)).otherwise(bare(F.col("raw")))).alias("v"))
    return rows.select("chunk_id", F.col("v").isNotNull().alias("parsed"), F.coalesce(F.try_variant_get("v", "$.year", "int"), F.lit(-1)).alias("year"))
