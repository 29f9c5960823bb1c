"""SQL of the training-data queries that SQL can express on whole tables."""

SQL: dict[str, str] = {}

SQL["p4_found"] = """
SELECT 'chunks' AS tab, chunk_id AS row_id FROM chunks WHERE length(text) > 1500
UNION ALL
SELECT 'private_papers' AS tab, id AS row_id FROM private_papers WHERE length(text) > 1500
"""

_CANON = "lower(regexp_replace(coalesce({}, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


def _c(x: str) -> str:
    return _CANON.format(x)


_FIELDS = "(subject|predicate|object|conditions|magnitude)"

SQL["p5_records"] = f"""
WITH r AS (
  SELECT id, {_c("source_concept")} AS a, {_c("relation_type")} AS r, {_c("target_concept")} AS b, {_c("conditions")} AS c FROM causal_relations
), causal AS (
  SELECT 'causal_relations' AS tab, id,
    CASE WHEN r IN ('analogousto', 'contradicts', 'sharesmechanism') THEN concat_ws(chr(1), least(a, b), r, greatest(a, b), c) ELSE concat_ws(chr(1), a, r, b, c) END AS k FROM r
), marked AS (
  SELECT id, belief_text, string_split(regexp_replace(coalesce(belief_text, ''), '{_FIELDS}([^\\p{{L}}\\p{{N}}:=]*[:=])', chr(1) || '\\1' || chr(2) || '\\2', 'gi'), chr(1)) AS p FROM beliefs
), belief AS (
  SELECT 'beliefs' AS tab, id,
    CASE WHEN len(p) >= 3 AND {_c("p[1]")} = '' THEN array_to_string(list_sort(list_distinct(list_transform(p[2:], lambda x: {_c("split_part(x, chr(2), 1)")} || chr(2) || {_c("split_part(x, chr(2), 2)")}))), chr(1))
    ELSE {_c("belief_text")} END AS k FROM marked
)
SELECT tab, min(id) AS keep_id, count(*) AS n_copies FROM (SELECT * FROM causal UNION ALL SELECT * FROM belief) GROUP BY tab, k
"""

SQL["p5_found"] = SQL["p5_records"].replace("SELECT tab, min(id) AS keep_id, count(*) AS n_copies FROM (SELECT * FROM causal UNION ALL SELECT * FROM belief) GROUP BY tab, k", """SELECT tab, keep_id, id AS dup_id FROM (
  SELECT tab, id, min(id) OVER (PARTITION BY tab, k) AS keep_id FROM (SELECT * FROM causal UNION ALL SELECT * FROM belief)
) WHERE id <> keep_id""")

SQL["p6_found"] = """
WITH ls AS (
  SELECT chunk_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM chunks WHERE source IS NOT NULL
), ks AS (
  SELECT chunk_id, source, line_no, lower(regexp_replace(line, '[^\\p{L}]+', '', 'g')) AS k FROM ls
), hot AS (
  SELECT source, k FROM ks WHERE k <> '' GROUP BY source, k
  HAVING count(DISTINCT chunk_id) >= 5 AND count(DISTINCT chunk_id) >= 0.05 * (SELECT count(*) FROM chunks c WHERE c.source = ks.source)
)
SELECT chunk_id, CAST(line_no AS BIGINT) AS line_no FROM ks JOIN hot USING (source, k)
"""

SQL["p8_found"] = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL
), dw AS (
  SELECT doc_id, array_to_string(w[k:k + 13], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 12)) AS k FROM d)
), iw AS (
  SELECT item_id, array_to_string(w[k:k + 13], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 12)) AS k FROM i)
)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)
"""

SQL["p2_found"] = """
WITH w AS (SELECT chunk_id, regexp_extract_all(lower(coalesce(paper_title, '') || ' ' || text), '[\\p{L}\\p{N}]+') AS w FROM chunks),
s AS (SELECT DISTINCT chunk_id, hash(w[k], w[k + 1], w[k + 2]) AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id),
f AS (SELECT s.*, n.n, count(*) OVER (PARTITION BY g) AS df FROM s JOIN n USING (chunk_id)),
r AS (SELECT chunk_id, g, n, row_number() OVER (PARTITION BY chunk_id ORDER BY df, g) AS place FROM f),
c AS (SELECT DISTINCT a.chunk_id AS a, b.chunk_id AS b, a.n AS na, b.n AS nb FROM r a JOIN r b ON a.g = b.g AND a.chunk_id < b.chunk_id WHERE a.place <= a.n - ceil(a.n / 2.0) + 1 AND b.place <= b.n - ceil(b.n / 2.0) + 1 AND least(a.n, b.n) >= 0.5 * greatest(a.n, b.n)),
m AS (SELECT c.a, c.b, c.na, c.nb, count(*) AS common FROM c JOIN s x ON x.chunk_id = c.a JOIN s y ON y.chunk_id = c.b AND x.g = y.g GROUP BY ALL)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM m WHERE common >= 0.5 * (na + nb - common)
"""

SQL["p6_cleaned"] = SQL["p6_found"].replace("SELECT chunk_id, CAST(line_no AS BIGINT) AS line_no FROM ks JOIN hot USING (source, k)", """, gone AS (SELECT chunk_id, line_no FROM ks JOIN hot USING (source, k)),
kept AS (SELECT chunk_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM ls WHERE (chunk_id, line_no) NOT IN (SELECT (chunk_id, line_no) FROM gone) GROUP BY chunk_id),
cnt AS (SELECT chunk_id, count(*) AS n FROM gone GROUP BY chunk_id)
SELECT c.chunk_id, CASE WHEN n IS NULL THEN c.text ELSE coalesce(kept.text, '') END AS text, coalesce(n, 0)::INT AS n_removed FROM chunks c LEFT JOIN cnt USING (chunk_id) LEFT JOIN kept USING (chunk_id)""").replace(")\n, gone", "), gone")

SQL["p7_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
