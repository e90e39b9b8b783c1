"""SQL statements of the registered pack queries, for a second engine."""

from __future__ import annotations

REFS = """
WITH cat AS (SELECT CASE WHEN lang = 'es' THEN 'cog:' ELSE 'D' END || doc_id AS id, source, lang, sha256(text) AS h, text FROM documents)
, refs AS (SELECT 'task-' || source AS task_id, doc_id AS position,
    CASE WHEN lang = 'es' THEN 'cog:' ELSE 'D' END || doc_id || CASE WHEN quality = 0 THEN '-gone' ELSE '' END AS chunk_id,
    CASE WHEN toxic = 1 THEN md5(text) ELSE sha256(text) END AS rh FROM documents JOIN labels USING (doc_id))
, res AS (SELECT r.*, c.id AS cid, c.source, c.lang, c.text, c.h,
    CASE WHEN c.id IS NULL THEN 'missing' WHEN c.h <> r.rh THEN 'stale' ELSE 'ok' END AS state,
    row_number() OVER (PARTITION BY task_id ORDER BY position, chunk_id) AS place_no
  FROM refs r LEFT JOIN cat c ON c.id = r.chunk_id)
"""
EXCHANGE = """
WITH ev AS (SELECT 't' || conv_id AS task_id, 't' || conv_id || ':' || turn AS chunk_id, text FROM conversations WHERE role = 'user')
, cl AS (SELECT 't' || conv_id AS task_id, turn AS pos, 'c' || turn AS claim_id, text,
    CASE WHEN length(text) < 200 THEN 'uncertain' WHEN length(text) < 600 THEN 'inference' ELSE 'supported' END AS st,
    CASE WHEN length(text) > 1500 THEN NULL ELSE 't' || conv_id || ':' || (turn - 1) END AS ref FROM conversations WHERE role = 'assistant')
, ck AS (SELECT cl.*, ref IN (SELECT chunk_id FROM ev) AS ok FROM cl)
, tasks AS (SELECT DISTINCT 't' || conv_id AS task_id FROM conversations)
, rep AS (SELECT t.task_id, count(*) FILTER (st <> 'uncertain') AS factual,
    count(*) FILTER (st <> 'uncertain' AND coalesce(ok, false)) AS cited,
    count(*) FILTER (ref IS NOT NULL AND NOT ok) AS bad,
    min(CASE WHEN ref IS NOT NULL AND NOT ok THEN ref END) AS bad_ref,
    count(claim_id) - count(DISTINCT claim_id) AS dup FROM tasks t LEFT JOIN ck USING (task_id) GROUP BY ALL)
, dr AS (SELECT *, CASE WHEN factual > 0 THEN cited::DOUBLE / factual END AS cov,
    CASE WHEN factual > 0 THEN (factual - cited)::DOUBLE / factual END AS uns FROM rep)
, o AS (SELECT 't' || conv_id AS task_id, max(CASE WHEN turn = 0 THEN length(text) END) AS n0, min(length(text)) AS nmin,
    count(*) FILTER (turn = 1) AS has1 FROM conversations GROUP BY ALL)
, g AS (SELECT task_id, nmin >= 60 AS man, n0 % 13 <> 0 AS sch, n0 % 7 <> 0 AS tid, n0 % 5 <> 0 AND has1 > 0 AS pro, bad = 0 AS member, coalesce(cov >= 0.95, false) AS covered, coalesce(uns <= 0.05, false) AS few, dup = 0 AS formed,
    NOT EXISTS (SELECT 1 FROM ev WHERE ev.task_id = dr.task_id AND length(ev.text) > 900) AS fresh FROM dr JOIN o USING (task_id))
, fi AS (SELECT *, CASE WHEN NOT man THEN 'manifest' WHEN NOT sch THEN 'result_schema' WHEN NOT tid THEN 'task_id'
    WHEN NOT pro THEN 'prompt_sha' WHEN NOT member THEN 'evidence_membership' WHEN NOT formed THEN 'citation_coverage'
    WHEN NOT covered THEN 'citation_coverage' WHEN NOT few THEN 'unsupported_claim' WHEN NOT fresh THEN 'stale' END AS ff FROM g)
"""
FILES = """
WITH f AS (SELECT conv_id AS task_id, 'f' || lpad(turn::VARCHAR, 3, '0') AS name, text, role FROM conversations)
"""

SQL = {
    "evidence_resolve": REFS + "SELECT task_id, chunk_id, state, source AS section_id FROM res",
    "evidence_pack": REFS + """
SELECT task_id, 'EV' || lpad(place_no::VARCHAR, 3, '0') AS evidence_id, chunk_id, coalesce(cid, '') AS document_id,
  source || ' > ' || lang AS title, coalesce(source || '|' || lang, '') AS heading_path,
  len(string_split(text, chr(10))) AS end_line, md5(substr(text, 1, 1200)) AS excerpt_digest, state FROM res
WHERE task_id IN (SELECT task_id FROM refs GROUP BY task_id HAVING count(*) <= 20)""",
    "evidence_excerpts": REFS + "SELECT task_id, 'E' || place_no AS ref_id, chunk_id, state, substr(text, 1, 1200) AS excerpt FROM res WHERE place_no <= 20",
    "pack_admission": REFS + """
, t AS (SELECT 'task-' || source AS task_id, count(*) FILTER (lang = 'de') AS n_de FROM documents GROUP BY ALL)
, n AS (SELECT task_id, count(*) AS n_refs FROM refs GROUP BY ALL)
SELECT t.task_id, coalesce(n_refs, 0) AS n_refs, CASE WHEN n_de > 6 THEN 'empty_query' WHEN coalesce(n_refs, 0) = 0 THEN 'no_evidence'
  WHEN n_refs > 20 THEN 'too_much_evidence' END AS reason FROM t LEFT JOIN n USING (task_id)""",
    "task_ids": """
WITH b AS (SELECT doc_id, strftime(make_timestamp((1700000000 + n_chars % 10) * 1000000), '%Y%m%d_%H%M%S') || '_' ||
    coalesce(nullif(trim(substr(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), '-'), 1, 40), '-'), ''), 'task') AS base FROM documents)
, r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS k FROM b)
SELECT doc_id AS seq, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS task_id FROM r""",
    "claim_coverage": EXCHANGE + """
SELECT task_id, factual AS factual_claims, cited AS cited_claims, factual - cited AS unsupported_claims, bad AS citation_invalid,
  dup AS duplicate_claim_ids, round(cov, 6) AS citation_coverage, round(uns, 6) AS unsupported_claim_rate, dup = 0 AS schema_valid,
  coalesce(cov >= 0.95, false) AND coalesce(uns <= 0.05, false) AND bad = 0 AND dup = 0 AND factual > 0 AS passed FROM dr""",
    "gate_first_failure": EXCHANGE + """
SELECT task_id, ff IS NULL AS passed, ff AS first_failure, coalesce(ff = 'stale', false) AS stale,
  CASE WHEN ff = 'manifest' THEN 1 WHEN ff = 'result_schema' THEN 2 WHEN ff = 'task_id' THEN 3 WHEN ff = 'prompt_sha' THEN 4
    WHEN ff = 'evidence_membership' THEN 5 WHEN NOT formed THEN 6 WHEN ff IS NULL OR ff = 'stale' THEN 9 ELSE 8 END::BIGINT AS gates_run FROM fi""",
    "run_rollup": EXCHANGE + """
SELECT count(*) AS tasks, count(*) FILTER (ff IS NULL) AS passed, count(*) FILTER (man) AS manifest_ok, count(*) FILTER (dup = 0) AS schema_ok,
  sum(bad)::BIGINT AS citation_invalid, count(*) FILTER (cov >= 0.95) AS coverage_ok, count(*) FILTER (uns <= 0.05) AS unsupported_ok
FROM fi JOIN dr USING (task_id)""",
    "claim_pairs": EXCHANGE + """
SELECT task_id, claim_id, substr(text, 1, 160) AS claim_text, st AS epistemic_state, ref AS chunk_id FROM cl WHERE st <> 'uncertain' AND ref IS NOT NULL""",
    "manifest_hashes": FILES + """
SELECT task_id, count(*) AS n_files, max(CASE WHEN name = 'f000' THEN sha256(text) END) AS first_hash,
  count(*) FILTER (role = 'user') AS evidence_count, count(*) FILTER (role = 'assistant') AS context_count FROM f GROUP BY ALL""",
    "manifest_gate": FILES + """
, b AS (SELECT task_id, min(CASE WHEN length(text) < 60 THEN name END) AS bad FROM f GROUP BY ALL)
SELECT task_id, bad IS NULL AS passed, CASE WHEN bad IS NOT NULL THEN 'file differs: ' || bad END AS failure FROM b""",
    "pack_status": """
WITH o AS (SELECT conv_id, length(text) AS n0 FROM conversations WHERE turn = 0)
, p AS (SELECT conv_id AS task_id, CASE WHEN n0 < 150 THEN 'outbox' WHEN n0 < 250 THEN 'failed' ELSE 'completed' END AS place,
  bool_or(length(text) > 1500) AS inv, bool_or(length(text) BETWEEN 1001 AND 1500) AS imp, bool_or(length(text) BETWEEN 701 AND 1000) AS don,
  bool_or(length(text) BETWEEN 601 AND 700) AS fai FROM conversations JOIN o USING (conv_id) GROUP BY ALL)
SELECT task_id, place, CASE WHEN place = 'outbox' THEN 'READY' WHEN place = 'failed' THEN CASE WHEN fai THEN 'FAILED' ELSE 'PROCESSING' END
  WHEN inv THEN 'INVALID_RESULT' WHEN imp THEN 'IMPORTED' WHEN don THEN 'COMPLETED' ELSE 'PROCESSING' END AS status FROM p""",
    "task_set_check": """
WITH a AS (SELECT 't' || doc_id AS task_id, n_chars FROM documents WHERE lang IN ('de', 'en'))
, e AS (SELECT 't' || doc_id AS task_id FROM labels)
, j AS (SELECT coalesce(a.task_id, e.task_id) AS task_id, CASE WHEN a.task_id IS NULL THEN 'missing_task' WHEN e.task_id IS NULL THEN 'unexpected_task'
  WHEN n_chars <= 200 THEN 'missing_file:result/run_meta.json,result/DONE' WHEN n_chars <= 300 THEN 'missing_file:result/run_meta.json' END AS problem
  FROM a FULL JOIN e ON a.task_id = e.task_id)
SELECT task_id, problem FROM j WHERE problem IS NOT NULL""",
    "incremental_ingest": """
SELECT user_id, count(*) AS n_events, max(event_id) AS last_event FROM events GROUP BY user_id""",
}
