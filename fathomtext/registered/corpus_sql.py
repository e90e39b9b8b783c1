"""SQL statements of the registered corpus queries, for a second engine."""

from __future__ import annotations

ARCHIVE = """
WITH arch AS (
  SELECT 'kb/' || CASE source WHEN 'src0' THEN '02_主题研究报告' WHEN 'src1' THEN '01_综合主报告' WHEN 'src2' THEN '版本存档' ELSE source END
    || '/' || CASE WHEN lang = 'fr' AND n_chars < 600 THEN '01_' WHEN n_chars < 300 THEN '开题报告_' WHEN n_chars < 700 THEN 'note_' ELSE '最终报告_' END
    || 'd' || doc_id || '.md' AS path,
    CASE WHEN n_chars > 2000 THEN upper(lang) || '1' END AS report_code, sha256(text) AS sha256,
    strlen(text) AS size, * FROM documents)
, keyed AS (
  SELECT *, regexp_extract(path, '([^/]+)\\.md$', 1) AS stem, split_part(path, '/', 2) AS folder,
    CASE WHEN contains(path, '最终报告') THEN 0 ELSE 1 END AS kind,
    CASE split_part(path, '/', 2) WHEN '02_主题研究报告' THEN 0 WHEN '01_综合主报告' THEN 1 ELSE 9 END AS pri FROM arch)
, judged AS (
  SELECT *, CASE WHEN folder = '版本存档' THEN 'EXCLUDED_DIR'
    WHEN contains(stem, '开题报告') OR regexp_matches(stem, '^(0\\d[a-z]?|10)_') THEN 'EXCLUDED_PROCESS'
    WHEN NOT contains(stem, '最终报告') THEN 'EXCLUDED_NON_FINAL' END AS reason,
    coalesce(report_code, stem) AS code_id FROM keyed)
"""
ORDER = "kind, pri, length(path), path"


def plan(rows: str, ident: str, known: str) -> str:
    """Kept copies, first per id, and what is left out."""
    return f"""
, cand AS (SELECT *, {ident} AS did FROM {rows})
, kept AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY did, sha256 ORDER BY {ORDER}) = 1)
, known AS ({known})
, met AS (SELECT k.*, CASE WHEN n.sha256 = k.sha256 AND n.source_path <> k.path THEN n.source_path END AS indexed_as
  FROM kept k LEFT JOIN known n ON n.id = k.did)
, ass AS (SELECT path, did, sha256, row_number() OVER (PARTITION BY did ORDER BY {ORDER}) AS rn FROM met WHERE indexed_as IS NULL)
, exc AS (SELECT c.path, 'EXCLUDED_DUPLICATE' AS reason, coalesce(m.indexed_as, m.path) AS kept_path
  FROM cand c JOIN met m ON m.did = c.did AND m.sha256 = c.sha256 WHERE c.path <> m.path OR m.indexed_as IS NOT NULL)
"""


NO_KNOWN = "SELECT NULL::VARCHAR AS id, NULL::VARCHAR AS sha256, NULL::VARCHAR AS source_path WHERE false"
KNOWN = """SELECT code_id AS id, sha256, 'old/' || path AS source_path FROM judged
  WHERE reason IS NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  QUALIFY row_number() OVER (PARTITION BY code_id ORDER BY path) = 1"""
ADMITTED = "(SELECT * FROM judged WHERE reason IS NULL)"
ASSIGNED = """SELECT path, CASE WHEN rn = 1 THEN did ELSE did || '__' || left(sha256, 8) END AS document_id,
  rn > 1 AS disambiguated FROM ass"""
REFUSED = """SELECT path, reason, NULL::VARCHAR AS kept_path FROM judged WHERE reason IS NOT NULL
  UNION ALL SELECT path, reason, kept_path FROM exc"""

VERSIONS = """
WITH d AS (SELECT *, source || '/' || lang || '/d' || doc_id || '.md' AS path, strlen(text) AS size, sha256(text) AS sha FROM documents)
, m AS (SELECT 'D' || d.doc_id AS id, CASE WHEN quality = 0 THEN 'old/' ELSE '' END || path AS path, size + toxic AS size,
    d.doc_id * 1000 AS mt, CASE WHEN toxic = 1 THEN sha256(text || '!') ELSE sha END AS sha
  FROM d JOIN labels USING (doc_id))
, j AS (SELECT coalesce(d.path, m.path) AS path, d.path IS NOT NULL AS disk, m.path IS NOT NULL AS known, m.id,
    d.sha AS sha, m.sha AS msha, d.size AS size, d.size = m.size AND d.doc_id * 1000 = m.mt AS same
  FROM d FULL JOIN m ON d.path = m.path)
, gone AS (SELECT msha, min(path) AS path, arg_min(id, path) AS id FROM j WHERE NOT disk GROUP BY msha)
, st AS (
  SELECT path, CASE WHEN same OR sha = msha THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status, NULL::VARCHAR AS renamed_from, id AS document_id
  FROM j WHERE disk AND known
  UNION ALL
  SELECT j.path, CASE WHEN g.path IS NULL THEN 'NEW' ELSE 'RENAMED' END, g.path, g.id FROM j LEFT JOIN gone g ON g.msha = j.sha
  WHERE disk AND NOT known)
, al AS (SELECT * FROM st UNION ALL
  SELECT path, 'DELETED', NULL, id FROM j WHERE NOT disk AND path NOT IN (SELECT renamed_from FROM st WHERE renamed_from IS NOT NULL))
"""

LINES = """
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls0 FROM documents)
, arr AS (SELECT doc_id, CASE WHEN ls0[-1] = '' THEN ls0[1:len(ls0) - 1] ELSE ls0 END AS ls FROM raw)
, lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n, len(ls) AS total FROM arr)
"""

TREE = LINES + """
, heads AS (
  SELECT doc_id, n, total, regexp_replace(trim(line), '\\s*#*\\s*$', '') AS heading,
    CASE WHEN n = 1 THEN 1 WHEN length(line) BETWEEN 1 AND 39 THEN 2 WHEN length(line) BETWEEN 40 AND 79 THEN 3 END AS level FROM lines)
, h AS (SELECT *, row_number() OVER w AS pos, coalesce(lead(n) OVER w - 1, total) AS end_line FROM heads WHERE level IS NOT NULL
  WINDOW w AS (PARTITION BY doc_id ORDER BY n))
, t AS (SELECT *, last_value(CASE WHEN level = 2 THEN pos END IGNORE NULLS) OVER w AS p2,
    last_value(CASE WHEN level = 2 THEN heading END IGNORE NULLS) OVER w AS h2,
    first_value(heading) OVER (PARTITION BY doc_id ORDER BY n) AS title
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, sec AS (SELECT doc_id, level, heading, n AS start_line, end_line, pos - 1 AS ordinal,
    CASE WHEN level = 1 THEN 'top1' WHEN level = 2 OR p2 IS NULL THEN 'top1:o' || pos ELSE 'top1:o' || p2 || ':o' || pos END AS sid,
    CASE WHEN level = 1 THEN NULL WHEN level = 2 OR p2 IS NULL THEN 'top1' ELSE 'top1:o' || p2 END AS pid,
    CASE WHEN level = 1 THEN heading WHEN level = 2 OR p2 IS NULL THEN title || ' > ' || heading ELSE title || ' > ' || h2 || ' > ' || heading END AS heading_path
  FROM t)
"""

PAGES = """
WITH md AS (SELECT page_id AS document_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '<h1[^>]*>', chr(10) || '# ', 'g'),
    '</?(?:p|li|ul|h1|br)[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') AS text FROM pages)
, raw AS (SELECT document_id, string_split(text, chr(10)) AS ls0 FROM md)
, arr AS (SELECT document_id, CASE WHEN ls0[-1] = '' THEN ls0[1:len(ls0) - 1] ELSE ls0 END AS ls FROM raw)
, lines AS (SELECT document_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n, len(ls) AS total FROM arr)
, heads AS (SELECT *, length(regexp_extract(line, '^(#{1,4})\\s', 1)) AS level,
    trim(regexp_extract(line, '^#{1,4}\\s+(.*?)\\s*#*\\s*$', 1)) AS heading FROM lines)
"""
PLAIN = "{}"
for _pattern, _kept in (
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]+)\]\([^)]*\)", r"\1"),
    (r"`([^`]+)`", r"\1"),
    (r"(?m)^\s*\|", ""),
    (r"(?m)\|\s*$", ""),
    (r"(?m)^\s*\|?[\s:|\-]+\|?\s*$", ""),
    (r"(?m)^#{{1,6}}\s+", ""),
    (r"\*\*(.+?)\*\*|\*(.+?)\*|__(.+?)__|_(.+?)_", r"\1\2\3\4"),
):
    PLAIN = f"regexp_replace({PLAIN}, '{_pattern}', '{_kept}', 'g')"
PLAIN = f"trim(regexp_replace({PLAIN}, '\\n{{{{3,}}}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"

STATS = """count(*) AS chunk_count, min(n)::BIGINT AS min, max(n)::BIGINT AS max, round(avg(n), 1) AS mean,
  sum((n > 2200)::INT)::BIGINT AS oversized"""
for _p, _q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95)):
    STATS += f", list_sort(list(n))[least(floor(count(*) * {_q}::DOUBLE)::BIGINT, count(*) - 1) + 1]::BIGINT AS {_p}"

UUID5 = """(SELECT substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-'
  || translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(d, 18, 3) || '-' || substr(d, 21, 12)
  FROM (SELECT sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('chunk:' || doc_id || ':' || n)) AS d))"""

NUMBERED = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
, u AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS k FROM l)
, g AS (SELECT doc_id, n, k, k % 6 AS g, k // 6 + 1 AS c, substr(md5(line), 1, 8) AS h,
    3 + 22 * (k // 6) + [0, 2, 6, 10, 14, 18][k % 6 + 1] AS sl FROM u)
, s AS (SELECT *, 'ch' || c AS chapter,
    CASE g WHEN 0 THEN 'ch' || c WHEN 1 THEN 'ch' || c || '-1' WHEN 2 THEN 'ch' || c || '-1:x1' WHEN 3 THEN 'ch' || c || '-1:x1:o2'
      ELSE 'ch' || c || ':o' || (5 * (c - 1) + 6) END AS sid,
    4 + 22 * (n // 6) + [0, 2, 6, 10, 14, 18][n % 6 + 1] - 1 AS fin FROM g)
"""

SQL = {
    "sampled_recheck": """
WITH s AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT 50)
, f AS (SELECT doc_id, doc_id % 5 <> 0 AS title_ok, (doc_id % 7 = 0 AND n >= 3)::INT::BIGINT AS lost, (doc_id % 11 = 0)::INT::BIGINT AS altered FROM s)
SELECT doc_id::VARCHAR AS document_id, title_ok, lost AS sections_missing, 0::BIGINT AS sections_extra, altered AS chunks_missing,
  altered AS chunks_extra, title_ok AND lost = 0 AND altered = 0 AS passed FROM f""",
    "marked_chunks": NUMBERED + """
, p AS (SELECT s.*, 'T' || s.doc_id || ' > 第' || s.c || '章 ' || z.h || CASE s.g WHEN 0 THEN '' WHEN 3 THEN ' > ' || s.c || '.1 ' || y.h || ' > (2) ' || s.h
    WHEN 4 THEN ' > ' || s.h WHEN 5 THEN ' > ' || x.h ELSE ' > ' || s.c || '.1 ' || s.h END AS path
  FROM s JOIN s z ON z.doc_id = s.doc_id AND z.c = s.c AND z.g = 0
  LEFT JOIN s y ON y.doc_id = s.doc_id AND y.c = s.c AND y.g = 2 LEFT JOIN s x ON x.doc_id = s.doc_id AND x.c = s.c AND x.g = 4)
, b AS (
  SELECT doc_id, sid, path, 'code' AS kind, sl + 1 AS a, sl + 3 AS z, NULL::BIGINT AS level, '```python' || chr(10) || h || chr(10) || '```' AS raw,
    '``python' || chr(10) || h || chr(10) || '``' AS plain FROM p WHERE g = 1
  UNION ALL SELECT doc_id, sid, path, 'table', sl + 1, sl + 2, NULL, '| ' || h || ' |' || chr(10) || '| --- |', h FROM p WHERE g = 2
  UNION ALL SELECT doc_id, sid, path, 'formula', sl + 1, CASE WHEN k = n - 1 THEN fin ELSE sl + 3 END, NULL,
    '$$' || chr(10) || h || chr(10) || '$$' || CASE WHEN k = n - 1 THEN chr(10) || chr(10) || 'end' ELSE '' END,
    '$$' || chr(10) || h || chr(10) || '$$' || CASE WHEN k = n - 1 THEN chr(10) || chr(10) || 'end' ELSE '' END FROM p WHERE g = 3
  UNION ALL SELECT doc_id, sid, path, 'causal_chain', sl + 1, sl + 3, CASE WHEN k + 1 < n THEN 3 END, '```' || chr(10) || 'graph TD' || chr(10) || '```',
    '``' || chr(10) || 'graph TD' || chr(10) || '``' FROM p WHERE g = 4
  UNION ALL SELECT doc_id, sid, path, 'prose', sl, CASE WHEN k = n - 1 THEN fin ELSE sl END, 3,
    h || ' [L3]' || CASE WHEN k = n - 1 THEN chr(10) || chr(10) || 'end' ELSE '' END,
    h || ' [L3]' || CASE WHEN k = n - 1 THEN chr(10) || chr(10) || 'end' ELSE '' END FROM p WHERE g = 5
  UNION ALL SELECT doc_id, sid, path, 'prose', fin, fin, NULL, 'end', 'end' FROM p WHERE k = n - 1 AND g NOT IN (3, 5))
, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS ordinal FROM b)
SELECT doc_id || ':' || sid || ':' || lpad(ordinal::VARCHAR, greatest(4, length(ordinal::VARCHAR))::INT, '0') AS id, doc_id::VARCHAR AS document_id, ordinal,
  kind AS content_type, a::BIGINT AS start_line, z::BIGINT AS end_line, level AS evidence_level, false AS oversized, md5(raw) AS raw,
  md5('Document: T' || doc_id || chr(10) || 'Domain: unknown' || chr(10) || 'Section: ' || path || chr(10) || 'Content Type: ' || kind || chr(10)
    || 'Evidence: ' || coalesce('L' || level, 'unmarked') || chr(10) || chr(10) || plain) AS embedded FROM o""",
    "numbered_sections": NUMBERED + """
, hs AS (SELECT DISTINCT doc_id, 'top1' AS sid, NULL AS parent, 1 AS level, 'T' || doc_id AS heading, 1 AS sl, fin, '' AS ev FROM s
  UNION ALL SELECT doc_id, sid,
    CASE g WHEN 0 THEN NULL WHEN 3 THEN doc_id || ':' || chapter || '-1:x1' ELSE doc_id || ':' || chapter END,
    CASE g WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 2 END,
    CASE g WHEN 0 THEN '第' || c || '章 ' || h WHEN 3 THEN '(2) ' || h WHEN 4 THEN h ELSE c || '.1 ' || h END, sl, fin,
    CASE WHEN g = 4 AND k + 1 < n THEN '3' ELSE '' END FROM s WHERE g < 5)
SELECT doc_id AS document_id, sid AS section_id, parent AS parent_section_id, level::BIGINT AS level, heading, 'body' AS section_type,
  sl::BIGINT AS start_line, coalesce(lead(sl) OVER (PARTITION BY doc_id ORDER BY sl) - 1, fin)::BIGINT AS end_line, ev AS evidence FROM hs""",
    "marked_blocks": NUMBERED + """
, b AS (
  SELECT doc_id, sid, 0 AS pos, 'code' AS block_type, sl + 1 AS a, sl + 3 AS z, 'python' AS lang, '```python' || chr(10) || h || chr(10) || '```' AS t FROM s WHERE g = 1
  UNION ALL SELECT doc_id, sid, 0, 'table', sl + 1, sl + 2, NULL, '| ' || h || ' |' || chr(10) || '| --- |' FROM s WHERE g = 2
  UNION ALL SELECT doc_id, sid, 0, 'formula', sl + 1, sl + 3, NULL, '$$' || chr(10) || h || chr(10) || '$$' FROM s WHERE g = 3
  UNION ALL SELECT doc_id, sid, 0, 'mermaid', sl + 1, sl + 3, NULL, '```' || chr(10) || 'graph TD' || chr(10) || '```' FROM s WHERE g = 4
  UNION ALL SELECT doc_id, sid, 1, 'prose', sl, sl, NULL, h || ' [L3]' FROM s WHERE g = 5
  UNION ALL SELECT doc_id, sid, CASE g WHEN 0 THEN 0 WHEN 5 THEN 2 ELSE 1 END, 'prose', fin, fin, NULL, 'end' FROM s WHERE k = n - 1)
SELECT doc_id AS document_id, sid AS section_id, pos::BIGINT AS pos, block_type, a::BIGINT AS start_line, z::BIGINT AS end_line, lang,
  md5(t) AS digest FROM b""",
    "exact_duplicates": ARCHIVE + """
, g AS (SELECT sha256, count(*) AS n FROM arch GROUP BY sha256 HAVING count(*) > 1)
SELECT sha256, n, path FROM arch JOIN g USING (sha256)""",
    "canonical_assignment": ARCHIVE + plan("keyed", "lang", NO_KNOWN) + ASSIGNED,
    "canonical_duplicates": ARCHIVE + plan("keyed", "lang", NO_KNOWN) + "SELECT * FROM exc",
    "index_plan_assignments": ARCHIVE + plan(ADMITTED, "code_id", KNOWN) + ASSIGNED,
    "index_plan_exclusions": ARCHIVE + plan(ADMITTED, "code_id", KNOWN) + REFUSED,
    "exclusion_summary": ARCHIVE + plan(ADMITTED, "code_id", NO_KNOWN) + f"""
, x AS ({REFUSED})
SELECT reason, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM x), 2) AS percent FROM x GROUP BY reason""",
    "stratified_sample": ARCHIVE + """
SELECT reason, path, row_number() OVER (PARTITION BY reason ORDER BY md5(path || ':20260830'), path) AS draw_rank FROM judged
WHERE reason IS NOT NULL
QUALIFY draw_rank <= CASE reason WHEN 'EXCLUDED_DIR' THEN 40 ELSE 20 END""",
    "corpus_profile": """
WITH g AS (SELECT lang || '-' || source AS id, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY ALL)
SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes, 0::BIGINT AS bad_encoding,
  sum((trim(text) = '')::INT)::BIGINT AS empty, sum((strlen(text) > 5000000)::INT)::BIGINT AS large,
  (SELECT count(*) FROM g) AS unique_ids, (SELECT count(*) FROM g WHERE n > 1) AS repeated_ids,
  (SELECT sum(n)::BIGINT FROM g WHERE n > 1) AS files_with_repeated_ids FROM documents""",
    "files_per_directory": ARCHIVE + "SELECT split_part(path, '/', 2) AS top_dir, count(*) AS n FROM arch GROUP BY ALL",
    "scan_diff": VERSIONS + "SELECT path, status, renamed_from, document_id FROM al",
    "scan_counts": VERSIONS + "SELECT status, count(*) AS n FROM al GROUP BY ALL",
    "files_to_hash": VERSIONS + "SELECT path, size FROM j WHERE disk AND NOT coalesce(same, false)",
    "line_explode": LINES + "SELECT doc_id, n AS line_no, line FROM lines",
    "heading_tree": TREE + """
SELECT doc_id AS document_id, doc_id || ':' || sid AS id, CASE WHEN pid IS NOT NULL THEN doc_id || ':' || pid END AS parent_section_id,
  level::BIGINT AS level, heading, heading_path, CASE WHEN contains(lower(heading), 'vs') THEN 'comparison' ELSE 'body' END AS section_type,
  ordinal, start_line, end_line FROM sec""",
    "page_sections": PAGES + """
, h AS (SELECT * FROM heads WHERE level > 0)
SELECT document_id, row_number() OVER w - 1 AS ordinal, level::BIGINT AS level, heading,
  CASE WHEN contains(lower(heading), 'vs') THEN 'comparison' ELSE 'body' END AS section_type,
  n AS start_line, coalesce(lead(n) OVER w - 1, total)::BIGINT AS end_line
FROM h WINDOW w AS (PARTITION BY document_id ORDER BY n)""",
    "page_blocks": PAGES + """
, b AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY document_id ORDER BY n) AS sec, trim(line) = '' OR level > 0 AS brk FROM heads)
, r AS (SELECT *, n - row_number() OVER (PARTITION BY document_id ORDER BY n) AS run FROM b WHERE sec > 0 AND NOT brk)
SELECT document_id, 'prose' AS block_type, min(n) AS start_line, max(n) AS end_line, md5(trim(string_agg(line, chr(10) ORDER BY n))) AS digest
FROM r GROUP BY document_id, sec, run""",
    "evidence_levels": """
WITH t AS (SELECT doc_id, regexp_extract_all(text || ' [L' || (n_chars % 7) || ']' || ' [L' || (doc_id % 5 + 1) || ']'
    || ' [L' || (n_chars % 3 + 1) || ']', '\\[L([1-5])\\]', 1) AS ls FROM documents)
, u AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM t)
, f AS (SELECT doc_id, l, min(i) AS i FROM u GROUP BY ALL)
SELECT doc_id, string_agg(l, ',' ORDER BY i) AS levels, min(l::BIGINT) AS lowest FROM f GROUP BY doc_id""",
    "prose_packing": LINES.replace("WITH raw", "WITH RECURSIVE raw") + """
, para0 AS (SELECT doc_id, 2 * n - 1 AS ln, trim(line) AS t FROM lines WHERE trim(line) <> '')
, para1 AS (SELECT doc_id, ln, 0 AS k, t FROM para0 WHERE length(t) <= 2200
  UNION ALL SELECT doc_id, ln, k, substr(t, k * 2200 + 1, 2200)
    FROM (SELECT *, unnest(range(0, (length(t) - 1) // 2200 + 1)) AS k FROM para0 WHERE length(t) > 2200))
, para AS (SELECT doc_id, ln, t, row_number() OVER (PARTITION BY doc_id ORDER BY ln, k) AS i FROM para1)
, walk AS (
  SELECT doc_id, i, 1 AS ch, t AS cur, length(t) AS len, ln AS first_ln, t AS last_t, ln AS last_ln FROM para WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN w.len + length(p.t) > 1400 AND w.len >= 350 THEN w.ch + 1 ELSE w.ch END,
    CASE WHEN w.len + length(p.t) > 1400 AND w.len >= 350
      THEN CASE WHEN length(w.last_t) <= 300 THEN w.last_t || chr(10) || chr(10) || p.t ELSE p.t END
      ELSE w.cur || chr(10) || chr(10) || p.t END,
    CASE WHEN w.len + length(p.t) > 1400 AND w.len >= 350
      THEN length(p.t) + CASE WHEN length(w.last_t) <= 300 THEN length(w.last_t) ELSE 0 END ELSE w.len + length(p.t) END,
    CASE WHEN w.len + length(p.t) > 1400 AND w.len >= 350
      THEN CASE WHEN length(w.last_t) <= 300 THEN w.last_ln ELSE p.ln END ELSE w.first_ln END,
    p.t, p.ln
  FROM walk w JOIN para p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
, fin AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL AS last_one FROM walk
  QUALIFY row_number() OVER (PARTITION BY doc_id, ch ORDER BY i DESC) = 1)
SELECT doc_id || ':top1:' || lpad(ch::VARCHAR, 4, '0') AS id, ch::BIGINT AS ordinal, 'prose' AS content_type, first_ln AS start_line,
  last_ln AS end_line, len > 2200 AND ch = max(ch) OVER (PARTITION BY doc_id) AS oversized, length(cur) AS n_chars, sha256(cur) AS content_hash FROM fin""",
    "plain_texts": PAGES + """
, dm AS (SELECT doc_id, string_agg(CASE WHEN n = 1 THEN '# ' WHEN length(line) BETWEEN 1 AND 39 THEN '## '
    WHEN length(line) BETWEEN 40 AND 79 THEN '### ' ELSE '' END || line, chr(10) ORDER BY n) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) GROUP BY doc_id)
, al AS (SELECT 'document' AS kind, doc_id AS id, text FROM dm UNION ALL SELECT 'page', document_id, text FROM md)
, pl AS (SELECT kind, id, """ + PLAIN.format("text") + """ AS p FROM al)
SELECT kind, id, length(p) AS n_chars, md5(p) AS digest FROM pl""",
    "chunk_stats_by_language": f"SELECT lang, {STATS} FROM (SELECT lang, n_chars AS n FROM documents) GROUP BY lang",
    "chunk_stats_overall": f"SELECT {STATS} FROM (SELECT n_chars AS n FROM documents)",
    "chunk_gates": TREE + """
, c AS (SELECT doc_id, (n - 1) // 5 AS cut, min(n) AS s, max(n) AS e, max(length(line)) < 90 AS emp FROM lines GROUP BY ALL)
, nl AS (SELECT doc_id, CASE WHEN max(n) > 20 THEN max(n) - 1 ELSE max(n) END AS nl FROM lines GROUP BY ALL)
, bt AS (SELECT doc_id, sum((level = 2)::INT) AS bt, sum((level = 3)::INT) AS bf FROM sec
  WHERE level > 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = sec.doc_id AND c.s <= sec.start_line AND c.e >= sec.end_line) GROUP BY ALL)
, cs AS (SELECT doc_id, count(*) AS cs FROM c WHERE EXISTS (SELECT 1 FROM sec WHERE sec.doc_id = c.doc_id AND sec.start_line BETWEEN c.s AND c.e AND sid <> 'top1') GROUP BY ALL)
, du AS (SELECT doc_id, greatest(count(*) - 4, 0) AS du FROM c GROUP BY ALL)
, ow AS (SELECT doc_id, sum((e > nl OR s > e)::INT) AS il, sum(emp::INT) AS em FROM c JOIN nl USING (doc_id) GROUP BY ALL)
, z AS (SELECT nl.doc_id AS document_id, coalesce(bt, 0)::BIGINT AS broken_table, coalesce(bf, 0)::BIGINT AS broken_formula,
    coalesce(cs, 0)::BIGINT AS cross_section, coalesce(il, 0)::BIGINT AS invalid_line_range, coalesce(du, 0)::BIGINT AS duplicate_chunk_id,
    coalesce(em, 0)::BIGINT AS empty_chunk, 0::BIGINT AS broken_diagram
  FROM nl LEFT JOIN bt USING (doc_id) LEFT JOIN cs USING (doc_id) LEFT JOIN du USING (doc_id) LEFT JOIN ow USING (doc_id))
SELECT *, broken_table + broken_formula + cross_section + invalid_line_range + duplicate_chunk_id + empty_chunk = 0 AS gate_passed FROM z""",
    "real_chunk_gates": """
SELECT doc_id::VARCHAR AS document_id, 0::BIGINT AS broken_table, 0::BIGINT AS broken_formula, 0::BIGINT AS cross_section,
  0::BIGINT AS invalid_line_range, 0::BIGINT AS duplicate_chunk_id, 0::BIGINT AS empty_chunk, 0::BIGINT AS broken_diagram, true AS gate_passed FROM documents""",
    "index_counts": LINES + """
, k AS (SELECT doc_id, count(*) AS chunks, sum(regexp_matches(line, '[\\p{L}\\p{N}]')::INT)::BIGINT AS terms,
    sum((length(line) >= 10)::INT)::BIGINT AS trigrams FROM lines GROUP BY ALL)
, p AS (SELECT k.*, CASE WHEN l.doc_id IS NULL THEN 0 ELSE chunks END::BIGINT AS points FROM k LEFT JOIN labels l USING (doc_id))
SELECT doc_id AS document_id, chunks, terms, trigrams, points, chunks = terms AND terms = trigrams AND trigrams = points AS ok FROM p""",
    "index_totals": LINES + """
, k AS (SELECT count(*) AS chunks, sum(regexp_matches(line, '[\\p{L}\\p{N}]')::INT)::BIGINT AS terms,
    sum((length(line) >= 10)::INT)::BIGINT AS trigrams, sum((doc_id IN (SELECT doc_id FROM labels))::INT)::BIGINT AS points FROM lines)
SELECT *, chunks = terms AND terms = trigrams AND trigrams = points AS consistent FROM k""",
    "orphan_points": LINES + f"""
SELECT {UUID5} AS point_id, doc_id AS document_id FROM lines JOIN documents USING (doc_id)
WHERE doc_id IN (SELECT doc_id FROM labels) AND (lang = 'es' OR length(line) < 10)""",
    "documents_to_embed": LINES + """
, k AS (SELECT doc_id, count(*) AS chunks FROM lines GROUP BY ALL)
SELECT doc_id AS document_id, chunks, 0::BIGINT AS points FROM k WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "catalog_generation": """SELECT count(*) AS documents, min('0.' || length(source)) AS parser_version, min(source) AS chunker_version,
  min(lang) AS schema_version FROM documents""",
    "document_detail": TREE + """
SELECT d.doc_id AS id, lang, source, (SELECT count(*) FROM sec s WHERE s.doc_id = d.doc_id) AS section_count,
  (SELECT count(*) FROM lines l WHERE l.doc_id = d.doc_id) AS chunk_count FROM documents d""",
    "catalog_upsert": """
SELECT d.doc_id AS id, md5(text) AS sha256, CASE WHEN l.toxic = 0 THEN '2026-01-01' ELSE '2026-02-02' END AS created_at
FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT -doc_id - 1, 'before', '2026-01-01' FROM labels WHERE toxic = 1""",
    "children_replaced": LINES + """
SELECT doc_id AS document_id, doc_id || ':' || n AS id, length(line)::BIGINT AS n FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, doc_id || ':1', length(split_part(text, chr(10), 1)) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "chunk_samples": """SELECT lang AS content_type, doc_id AS document_id, md5(text) AS digest,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS sample_rank FROM documents QUALIFY sample_rank <= 3""",
    "facet_values": "SELECT DISTINCT source AS domain FROM documents WHERE source <> ''",
}
