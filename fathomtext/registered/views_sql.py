"""SQL statements of the registered view queries, for a second engine."""

from __future__ import annotations

from fathomtext.registered.corpus_sql import UUID5

POINT = UUID5.replace("doc_id || ':' || n", "'D' || doc_id || ':' || n")

SQL = {
    "rejected_queries": """SELECT doc_id AS query_id, CASE WHEN length(text) = 0 THEN 'empty' ELSE 'too_long' END AS reason
FROM documents WHERE length(text) = 0 OR length(text) > 500""",
    "run_catalog": "SELECT source AS run_id, count(DISTINCT lang) AS tasks FROM documents GROUP BY source",
    "new_tasks": "SELECT 'D' || doc_id AS task_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "last_deletions": """SELECT source || '/D' || doc_id AS source_path, 'D' || doc_id AS document_id,
  CASE WHEN toxic = 1 THEN sha256(text) ELSE md5(text) END AS last_sha256,
  CASE WHEN toxic = 1 THEN '2026-02-01' ELSE '2026-01-01' END AS deleted_at
FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0""",
    "job_log": """SELECT d.doc_id AS id, CASE quality WHEN 1 THEN 'done' WHEN 0 THEN 'failed' ELSE 'running' END AS status,
  n_chars AS created_at, l.doc_id * 10 AS finished_at, CASE WHEN quality = 0 THEN 'low quality' END AS error
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "recent_jobs": """SELECT d.doc_id AS id, CASE quality WHEN 1 THEN 'done' WHEN 0 THEN 'failed' ELSE 'running' END AS status,
  n_chars AS created_at, l.doc_id * 10 AS finished_at, CASE WHEN quality = 0 THEN 'low quality' END AS error
FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY n_chars DESC, d.doc_id DESC LIMIT 20""",
    "unit_vectors": """WITH n AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)
SELECT vec_id, round(e[1]::DOUBLE / n, 6) AS first, round(list_max(e)::DOUBLE / n, 6) AS largest FROM n""",
    "partial_results": """SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN md5(text) END AS summary_digest,
  CASE WHEN turn % 3 <> 2 THEN 1 END::BIGINT AS questions FROM conversations""",
    "manifest_shapes": """SELECT conv_id, conv_id % 7 <> 1 AND conv_id % 5 <> 1 AND conv_id % 3 <> 1 AND conv_id % 11 <> 1 AS valid
FROM conversations WHERE turn = 0""",
    "inconsistent_packs": """WITH c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT 't' || conv_id AS task_id, CASE WHEN conv_id % 7 = 0 THEN 'task_id' WHEN conv_id % 3 = 0 THEN 'evidence_count' ELSE 'context_count' END AS problem
FROM c WHERE conv_id % 7 = 0 OR conv_id % 3 = 0 OR conv_id % 5 = 0""",
    "ready_packs": """SELECT 't' || conv_id AS task_id FROM conversations GROUP BY conv_id
HAVING max(length(text)) > 700 AND max(length(text)) <= 1500""",
    "task_summaries": """SELECT 't' || conv_id AS task_id, 'review' AS task_type, 'q' AS query, 's' AS summary,
  count(*) FILTER (role = 'assistant') AS claims, 0::BIGINT AS tensions, 0::BIGINT AS uncertainties,
  count(*) FILTER (role = 'user') AS open_questions FROM conversations GROUP BY conv_id""",
    "repaired_points": f"""WITH p AS (SELECT doc_id, lang, 1 AS n FROM documents WHERE lang <> 'es')
SELECT doc_id AS document_id, {POINT} AS point_id,
  CASE WHEN lang = 'de' OR doc_id NOT IN (SELECT doc_id FROM labels) THEN 'new' ELSE 'old' END AS made FROM p""",
    "corpus_report": """WITH r AS (SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'poor' END AS reason FROM labels WHERE quality = 0)
SELECT 'files' AS measure, NULL::VARCHAR AS detail, count(*) AS n FROM documents
UNION ALL SELECT 'documents', NULL, count(*) FROM documents
UNION ALL SELECT 'sections', NULL, count(*) FROM pages
UNION ALL SELECT 'chunks', NULL, count(*) FROM documents
UNION ALL SELECT 'terms', NULL, count(*) FROM conversations
UNION ALL SELECT 'trigrams', NULL, count(*) FROM benchmark
UNION ALL SELECT 'points', NULL, count(*) FROM embeddings
UNION ALL SELECT 'skipped', NULL, count(*) FROM r
UNION ALL SELECT 'failed', NULL, count(*) FROM labels WHERE toxic = 1
UNION ALL SELECT 'encoding_failures', NULL, count(*) FROM labels WHERE toxic = 1 AND quality = 1
UNION ALL SELECT 'oversized_chunks', NULL, count(*) FROM documents WHERE length(text) > 2200
UNION ALL SELECT 'duplicate_document_ids', NULL, count(*) FROM (SELECT doc_id - doc_id % 2 AS i FROM documents GROUP BY i HAVING count(*) > 1)
UNION ALL SELECT 'skipped_by_reason', reason, count(*) FROM r GROUP BY reason""",
}
