"""SQL statements of the registered version queries, for a second engine."""

from __future__ import annotations

from fathomtext.registered.corpus_sql import SQL as CORPUS

STATES = """
WITH j AS (SELECT d.*, coalesce(quality, 1) AS q, coalesce(toxic, 0) AS t FROM documents d LEFT JOIN labels USING (doc_id))
, v2 AS (SELECT doc_id, CASE WHEN t = 1 THEN text || chr(10) || '!' ELSE text END AS text,
    CASE WHEN t = 1 THEN 'v2' ELSE 'v1' END AS written_by FROM j WHERE q = 1)
, f AS (SELECT doc_id, text || chr(10) || '?' AS text, 'v3' AS written_by FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents))
, v3 AS (SELECT * FROM v2 WHERE doc_id NOT IN (SELECT doc_id FROM f) UNION ALL SELECT * FROM f)
"""

SQL = {
    "published_documents": STATES + "SELECT 'D' || doc_id AS id, md5(text) AS sha256, written_by FROM v3",
    "earlier_version": STATES + "SELECT 'D' || doc_id AS id, md5(text) AS sha256, written_by FROM v2",
    "published_lines": STATES + """
, l AS (SELECT doc_id, written_by, string_split(text, chr(10)) AS ls FROM v3)
, u AS (SELECT doc_id, written_by, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n FROM l)
SELECT 'D' || doc_id AS document_id, n, md5(line) AS digest, written_by FROM u""",
    "deletion_log": STATES + """
SELECT 'files/D' || doc_id AS source_path, 'D' || doc_id AS document_id, md5(text) AS last_sha256, 'v2' AS deleted_at, 'v2' AS version
FROM j WHERE q = 0""",
    "scan_log": f"SELECT status, n, '2026-02-01' AS at, 'v1' AS version FROM ({CORPUS['scan_counts']}) c",
    "task_files": """
WITH a AS (SELECT conv_id, turn, md5(text) AS answer FROM conversations WHERE role = 'assistant')
, again AS (SELECT conv_id, turn, 'again ' || answer AS answer FROM a WHERE conv_id % 3 = 0 AND turn <= 3)
SELECT conv_id, turn, answer FROM a WHERE conv_id NOT IN (SELECT conv_id FROM again) UNION ALL SELECT * FROM again""",
    "listing_states": """
WITH s AS (SELECT n, CASE WHEN doc_id % 6 = 1 AND n > 0 THEN 'moved' ELSE source END || '/D' || doc_id AS path,
    doc_id * 1000 + (doc_id % 4 = n)::INT AS mtime, md5(text || CASE WHEN doc_id % 4 = n THEN '!' ELSE '' END) AS sha
  FROM documents, range(3) r(n) WHERE (doc_id + n) % 5 <> 0)
, pair AS (SELECT coalesce(c.n, p.n + 1) AS n, coalesce(c.path, p.path) AS path, c.path IS NOT NULL AS here, p.path IS NOT NULL AS known,
    c.sha, p.sha AS before, c.mtime = p.mtime OR c.sha = p.sha AS same
  FROM s c FULL JOIN s p ON p.n = c.n - 1 AND p.path = c.path WHERE coalesce(c.n, p.n + 1) < 3)
, origin AS (SELECT n, before AS sha, min(path) AS path FROM pair WHERE NOT here GROUP BY ALL)
, moved AS (SELECT x.n, x.path, o.path AS renamed_from FROM pair x LEFT JOIN origin o ON o.n = x.n AND o.sha = x.sha WHERE x.here AND NOT x.known)
SELECT n AS batch, path, CASE WHEN renamed_from IS NULL THEN 'NEW' ELSE 'RENAMED' END AS status, renamed_from FROM moved
UNION ALL SELECT n, path, CASE WHEN same THEN 'UNCHANGED' ELSE 'MODIFIED' END, NULL FROM pair WHERE here AND known
UNION ALL SELECT n, path, 'DELETED', NULL FROM pair x WHERE NOT here
  AND NOT EXISTS (SELECT 1 FROM moved m WHERE m.n = x.n AND m.renamed_from = x.path)""",
}
