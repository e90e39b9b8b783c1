"""SQL statements of the registered retrieval queries, for a second engine."""

from __future__ import annotations

import re

from fathomtext.functions.text import ACCENTED, UNACCENTED

FOLD = f"translate(lower({{}}), '{ACCENTED}', '{UNACCENTED}')"
WORDS = "regexp_extract_all(" + FOLD + ", '[\\p{{L}}\\p{{N}}]+')"


def words(c: str) -> str:
    return WORDS.format(c)


BM25_TAIL = """
, df AS (SELECT phrase, count(*) AS df FROM hits GROUP BY phrase)
, stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens)
, scored AS (
  SELECT q.query_id, h.chunk_id,
    round(sum(q.weight
      * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
      * (h.tf * 2.2) / (h.tf + 1.2 * (0.25 + 0.75 * l.dl / avgdl))), 9) AS score
  FROM q JOIN hits h USING (phrase) JOIN df USING (phrase) JOIN lens l ON l.chunk_id = h.chunk_id, stats
  GROUP BY q.query_id, h.chunk_id)
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
"""

TERMS = f"""
WITH toks AS (SELECT doc_id AS chunk_id, unnest({words('text')}) AS phrase FROM documents)
, hits AS (SELECT phrase, chunk_id, count(*) AS tf FROM toks GROUP BY ALL)
, lens AS (SELECT doc_id AS chunk_id, len({words('text')}) AS dl FROM documents)
, q AS (SELECT query_id, phrase, count(*) AS weight FROM (
    SELECT item_id AS query_id, unnest({words('text')}) AS phrase FROM benchmark) GROUP BY ALL)
{BM25_TAIL}"""

GRAM_TAIL = BM25_TAIL
for _name in ("hits", "lens", "stats", "scored", "ranked", "df"):
    GRAM_TAIL = GRAM_TAIL.replace(f", {_name} AS", f", g{_name} AS").replace(f"FROM {_name}", f"FROM g{_name}")
GRAM_TAIL = (
    GRAM_TAIL.replace("JOIN hits h", "JOIN ghits h").replace("JOIN df USING", "JOIN gdf USING")
    .replace("JOIN lens l", "JOIN glens l").replace("chunk_id, stats", "chunk_id, gstats").replace("FROM q JOIN", "FROM gq q JOIN")
)

GRAMS = f"""
  gq AS (SELECT query_id, phrase, count(*) AS weight FROM (
    SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS phrase FROM benchmark)
    WHERE length(phrase) >= 3 GROUP BY ALL)
, gp AS (SELECT DISTINCT phrase,
    [phrase || substr(phrase, i + 1) for i in range(1, length(phrase)) if left(phrase, i) = right(phrase, i)] AS twice FROM gq)
, gd AS (SELECT doc_id AS chunk_id, lower(text) AS body FROM documents)
, ghits AS (SELECT phrase, chunk_id,
    CASE WHEN len([o for o in twice if contains(body, o)]) > 0
      THEN len([i for i in range(1, length(body) - length(phrase) + 2) if substr(body, i, length(phrase)) = phrase])
      ELSE (length(body) - length(replace(body, phrase, ''))) // length(phrase) END AS tf
  FROM gd, gp WHERE contains(body, phrase))
, glens AS (SELECT chunk_id, greatest(length(body) - 2, 0) AS dl FROM gd)
{GRAM_TAIL}"""

FUSED = """
, fused AS (
  SELECT coalesce(t.query_id, g.query_id) AS query_id, coalesce(t.chunk_id, g.chunk_id) AS chunk_id,
    0.0::DOUBLE + coalesce(0.9::DOUBLE / (60 + t.rank), 0) + coalesce(0.7::DOUBLE / (60 + g.rank), 0) AS rrf,
    t.rank AS terms_rank, g.rank AS trigram_rank
  FROM (SELECT * FROM ranked WHERE rank <= 50) t
  FULL JOIN (SELECT * FROM granked WHERE rank <= 30) g
    ON t.query_id = g.query_id AND t.chunk_id = g.chunk_id)
"""

CENTROIDS = """
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
, m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL)
, cent AS (SELECT label AS query_id, list(m ORDER BY i) AS c FROM m GROUP BY label)
, cos AS (
  SELECT query_id, vec_id, label, embedding,
    round(list_cosine_similarity(embedding::DOUBLE[], c), 9) AS score FROM embeddings, cent)
"""

IDENT = "[A-Za-z0-9µμ°²±×′″$%+]+(?:[-:/_.+×·][A-Za-z0-9µμ°²±×′″$%+]+)*"

LOOKUPS = (
    "list_concat(list_filter(regexp_extract_all({q}, '" + IDENT + "'), lambda w: "
    "regexp_matches(w, '[-:/_.+]') OR (regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]'))), "
    "list_filter(regexp_split_to_array({q}, '\\s+'), lambda w: length(w) >= 2))"
)

RERANK_DOC = f"""
, pos AS (
  SELECT r.query_id, r.chunk_id, r.rank, d.text, d.lang, split_part(d.text, chr(10), 1) AS title, b.text AS query,
    list_filter(list_transform({LOOKUPS.format(q='b.text')}, lambda w: instr(d.text, w)), lambda p: p > 1)[1] AS p
  FROM ranked r JOIN documents d ON d.doc_id = r.chunk_id JOIN benchmark b ON b.item_id = r.query_id
  WHERE r.rank <= {{limit}})
, doc AS (
  SELECT *, 'Title: ' || title || chr(10) || 'Section: ' || chr(10) || 'Content Type: ' || lang || chr(10)
    || 'Evidence: Lunmarked' || chr(10) || chr(10)
    || CASE WHEN length(text) <= 1400 THEN text ELSE substr(text, 1, 500)
       || CASE WHEN p IS NULL THEN '' ELSE chr(10) || '……' || chr(10)
            || substr(text, greatest(0, p - 1 - 200) + 1, 400) || chr(10) || '……' END
       || chr(10) || '……（截断）' END AS document
  FROM pos)
"""

EMBED = """
  ew AS (SELECT doc_id, lang, unnest({doc_words}) AS w FROM documents)
, eb AS (SELECT doc_id, lang, (('0x' || substr(md5(w), 1, 7))::BIGINT % 128) AS b, count(*)::DOUBLE AS n FROM ew GROUP BY ALL)
, en AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM eb GROUP BY ALL)
, ev AS (SELECT eb.doc_id, lang, b, (n / norm)::FLOAT::DOUBLE AS n FROM eb JOIN en USING (doc_id))
, qw AS (SELECT item_id AS query_id, unnest({query_words}) AS w FROM benchmark)
, qb AS (SELECT query_id, (('0x' || substr(md5(w), 1, 7))::BIGINT % 128) AS b, count(*)::DOUBLE AS n FROM qw GROUP BY ALL)
, qn AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM qb GROUP BY ALL)
, qv AS (SELECT qb.query_id, b, (n / norm)::FLOAT::DOUBLE AS n FROM qb JOIN qn USING (query_id))
, en2 AS (SELECT doc_id, sqrt(sum(n * n)) AS m FROM ev GROUP BY ALL)
, qn2 AS (SELECT query_id, sqrt(sum(n * n)) AS m FROM qv GROUP BY ALL)
, edot AS (SELECT query_id, doc_id, lang, sum(ev.n * qv.n) AS dot FROM ev JOIN qv USING (b) GROUP BY ALL)
, ecos AS (SELECT query_id, doc_id, lang, round(dot / en2.m / qn2.m, 9) AS score
    FROM edot JOIN en2 USING (doc_id) JOIN qn2 USING (query_id))
"""
EMBED_TEXT = EMBED.format(doc_words=words("text"), query_words=words("text"))
EMBED_TITLE = EMBED.format(doc_words=words("split_part(text, chr(10), 1)"), query_words=words("text"))
for _n in ("ew", "eb", "en2", "en", "ev", "qw", "qb", "qn2", "qn", "qv", "edot", "ecos"):
    EMBED_TITLE = re.sub(rf"\b{_n}\b", f"s{_n}", EMBED_TITLE)

CHUNK_KEY = "lang || ':' || doc_id || ':0001' AS chunk_id"
HYBRID_LISTS = (TERMS + "," + GRAMS).replace("doc_id AS chunk_id", CHUNK_KEY) + "," + EMBED_TEXT + "," + EMBED_TITLE + """
, dl AS (SELECT query_id, lang || ':' || doc_id || ':0001' AS chunk_id,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lang || ':' || doc_id || ':0001') AS rank FROM ecos QUALIFY rank <= 50)
, sl AS (SELECT query_id, lang || ':' || doc_id || ':0001' AS chunk_id,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lang || ':' || doc_id) AS rank FROM secos QUALIFY rank <= 8)
, al AS (SELECT query_id, chunk_id, 0 AS src, rank FROM dl
  UNION ALL SELECT query_id, chunk_id, 1, rank FROM ranked WHERE rank <= 50
  UNION ALL SELECT query_id, chunk_id, 2, rank FROM granked WHERE rank <= 30)
, pv AS (SELECT query_id, chunk_id, max(CASE WHEN src = 0 THEN rank END) AS d, max(CASE WHEN src = 1 THEN rank END) AS t,
    max(CASE WHEN src = 2 THEN rank END) AS g, min(src) AS fs FROM al GROUP BY ALL)
, rr AS (SELECT *, 0.0::DOUBLE + coalesce(1.0::DOUBLE / (60 + d), 0) + coalesce(0.9::DOUBLE / (60 + t), 0)
    + coalesce(0.7::DOUBLE / (60 + g), 0) AS rrf FROM pv)
, bo AS (SELECT rr.*, CASE WHEN sl.chunk_id IS NULL THEN 1.0 ELSE 1.08 END::DOUBLE AS boost
  FROM rr LEFT JOIN sl ON sl.query_id = rr.query_id AND sl.chunk_id = rr.chunk_id)
, fi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf * boost DESC, fs, coalesce(d, t, g), chunk_id) AS rank FROM bo)
"""
HYBRID = HYBRID_LISTS + """SELECT query_id, rank, chunk_id, d AS dense_rank, t AS terms_rank, g AS trigram_rank, round(rrf, 6) AS rrf,
  boost AS section_boost, round(rrf * boost, 6) AS final FROM fi WHERE rank <= 10
"""

_RERANK = RERANK_DOC.format(limit=24).replace("FROM ranked r", "FROM upper r").replace("d.doc_id = r.chunk_id", "d.doc_id = r.doc")
SEVEN_ARMS = HYBRID_LISTS + """
, upper AS (SELECT query_id, chunk_id, split_part(chunk_id, ':', 2)::BIGINT AS doc, rank FROM fi WHERE rank <= 30)
""" + _RERANK + f"""
, again AS (SELECT u.query_id, u.chunk_id, u.rank AS pre_rank, x.s FROM upper u LEFT JOIN (
    SELECT query_id, chunk_id, len(list_intersect(list_distinct({words('query')}), {words('document')}))::DOUBLE
      / len(list_distinct({words('query')})) AS s FROM doc) x USING (query_id, chunk_id))
, lx AS (SELECT query_id, chunk_id, t, g, 0.0::DOUBLE + coalesce(0.9::DOUBLE / (60 + t), 0) + coalesce(0.7::DOUBLE / (60 + g), 0) AS rrf
    FROM pv WHERE t IS NOT NULL OR g IS NOT NULL)
, arms AS (
  SELECT 'terms' AS arm, query_id, rank, chunk_id FROM ranked WHERE rank <= 10
  UNION ALL SELECT 'trigram', query_id, rank, chunk_id FROM granked WHERE rank <= 10
  UNION ALL SELECT 'dense', query_id, rank, chunk_id FROM dl WHERE rank <= 10
  UNION ALL (SELECT 'lexical', query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC,
      CASE WHEN t IS NULL THEN 1 ELSE 0 END, coalesce(t, g), chunk_id) AS rank, chunk_id FROM lx QUALIFY rank <= 10)
  UNION ALL (SELECT 'hybrid', query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, fs, coalesce(d, t, g), chunk_id) AS rank,
      chunk_id FROM rr QUALIFY rank <= 10)
  UNION ALL SELECT 'hybrid_boost', query_id, rank, chunk_id FROM fi WHERE rank <= 10
  UNION ALL (SELECT 'hybrid_rerank', query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, pre_rank) AS rank,
      chunk_id FROM again QUALIFY rank <= 10))
"""

LETTERS, SIGNS = "abcdefghijklmnopqrstuvwxyz", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥乾坎艮震"
#: Longest first, so that the first that fits is the longest.
LISTED = ["quement", "istion", "tion", "ande", "the", "ion", "ent", "and", "ing", "eau", "ein", "eit", "que", "th", "os", "is"]
_SIGNS = [t.translate(str.maketrans(LETTERS, SIGNS)) for t in LISTED]

SQL = {
    "domain_terms": f"""
WITH r AS (SELECT doc_id, regexp_extract_all(replace(translate(lower(text), '{LETTERS}', '{SIGNS}'), ' ', ''), '[{SIGNS}]+') AS runs FROM documents)
, u AS (SELECT doc_id, unnest(runs) AS t, generate_subscripts(runs, 1) AS run FROM r)
, p AS (SELECT doc_id, run, list_filter(string_split(regexp_replace(t, '({'|'.join(_SIGNS)})', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ps FROM u)
, s AS (SELECT doc_id, run, flatten(list_transform(ps, lambda x: CASE WHEN x IN ({', '.join(f"'{t}'" for t in _SIGNS)}) OR length(x) <= 2 THEN [x]
    ELSE [substr(x, i, 2) for i in range(1, length(x))] END)) AS ts FROM p)
SELECT doc_id, run, len(ts) AS n, md5(array_to_string(ts, ' ')) AS digest FROM s""",
    "hybrid_search": HYBRID,
    "bm25_terms_topk": TERMS + "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10",
    "substring_truth": "SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM documents d, benchmark b WHERE contains(d.text, b.text)",
    "trigram_bm25_topk": "WITH" + GRAMS
    + "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM granked WHERE rank <= 30",
    "identifier_extract": f"""
WITH t AS (SELECT 'page' AS kind, page_id AS id, url AS t FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)
, f AS (SELECT kind, id, regexp_extract_all(t, '{IDENT}') AS ws FROM t)
, u AS (SELECT kind, id, unnest(ws) AS identifier, generate_subscripts(ws, 1) AS i FROM f)
, k AS (SELECT kind, id, identifier, min(i) AS i FROM u
  WHERE regexp_matches(identifier, '[-:/_.+]')
     OR (regexp_matches(identifier, '[A-Za-z]') AND regexp_matches(identifier, '[0-9]')) GROUP BY ALL)
SELECT kind, id, row_number() OVER (PARTITION BY kind, id ORDER BY i) AS pos, identifier FROM k""",
    "lexical_fusion": TERMS + "," + GRAMS + FUSED
    + "SELECT query_id, chunk_id, round(rrf, 8) AS rrf, terms_rank, trigram_rank FROM fused",
    "cosine_topk": CENTROIDS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cos)
SELECT query_id::BIGINT AS query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 50""",
    "cosine_topk_filtered": CENTROIDS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cos WHERE label IN (1, 2, 3))
SELECT query_id::BIGINT AS query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 20""",
    "rrf_fusion": CENTROIDS + """
, a AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cos QUALIFY rank <= 50)
, o AS (SELECT label AS query_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank
    FROM embeddings QUALIFY rank <= 50)
SELECT coalesce(a.query_id, o.query_id)::BIGINT AS query_id, coalesce(a.vec_id, o.vec_id) AS item_id,
  round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(0.9::DOUBLE / (60 + o.rank), 0), 8) AS rrf,
  a.rank AS dense_rank, o.rank AS terms_rank, NULL::BIGINT AS trigram_rank,
  CASE WHEN a.rank IS NOT NULL THEN 0 ELSE 1 END::BIGINT AS first_source, coalesce(a.rank, o.rank) AS first_rank
FROM a FULL JOIN o ON a.query_id = o.query_id AND a.vec_id = o.vec_id""",
    "prefix_boost": """
WITH n AS (SELECT conv_id, role, sum(length(text)) AS n FROM conversations GROUP BY ALL)
, best AS (SELECT conv_id, role FROM n QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role DESC) = 1)
SELECT c.conv_id AS query_id, concat(c.conv_id, ':', c.role, ':', lpad(c.turn::VARCHAR, 4, '0')) AS item_id,
  CASE WHEN b.role IS NULL THEN 1.0 ELSE 1.08 END::DOUBLE AS section_boost,
  round((1.0::DOUBLE / (60 + c.turn + 1)) * CASE WHEN b.role IS NULL THEN 1.0 ELSE 1.08 END::DOUBLE, 9) AS final
FROM conversations c LEFT JOIN best b ON b.conv_id = c.conv_id AND b.role = c.role""",
    "filtered_fused_topk": TERMS + """
, k AS (SELECT r.query_id, r.chunk_id, r.rank AS src, d.lang, split_part(d.text, chr(10), 1) AS title,
    0.9::DOUBLE / (60 + r.rank) AS final
  FROM ranked r JOIN documents d ON d.doc_id = r.chunk_id
  WHERE r.rank <= 50 AND d.lang IN ('en', 'de', 'es')
    AND d.source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9'))
, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, src) AS pre_rank FROM k)
SELECT query_id, pre_rank AS rank, pre_rank, chunk_id, title, lang AS content_type, round(final, 8) AS final
FROM p WHERE pre_rank <= 10""",
    "result_snippets": TERMS + f"""
, pos AS (SELECT r.query_id, r.chunk_id, d.text,
    list_filter(list_transform({LOOKUPS.format(q='b.text')}, lambda w: instr(d.text, w)), lambda p: p > 0)[1] AS p
  FROM ranked r JOIN documents d ON d.doc_id = r.chunk_id JOIN benchmark b ON b.item_id = r.query_id WHERE r.rank <= 30)
, s AS (SELECT *, greatest(0, p - 1 - 50) AS start FROM pos)
SELECT query_id, chunk_id, CASE WHEN p IS NULL
  THEN substr(text, 1, 200) || CASE WHEN length(text) > 200 THEN '…' ELSE '' END
  ELSE CASE WHEN start > 0 THEN '…' ELSE '' END || substr(text, start + 1, 200)
    || CASE WHEN start + 200 < length(text) THEN '…' ELSE '' END END AS snippet FROM s""",
    "rerank_inputs": TERMS + RERANK_DOC.format(limit=30) + "SELECT query_id, chunk_id, document FROM doc",
    "rerank_reorder": TERMS + RERANK_DOC.format(limit=24) + f"""
, o AS (SELECT query_id, chunk_id, rank,
    len(list_intersect(list_distinct({words('query')}), {words('document')}))::DOUBLE / len(list_distinct({words('query')})) AS s FROM doc)
, a AS (SELECT r.query_id, r.chunk_id, r.rank AS pre_rank, o.s FROM ranked r LEFT JOIN o USING (query_id, chunk_id) WHERE r.rank <= 30)
, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, pre_rank) AS rank FROM a)
SELECT query_id, rank, pre_rank, chunk_id, round(s, 6) AS reranker FROM f WHERE rank <= 10""",
    "highlighted_titles": TERMS + """
, k AS (SELECT r.query_id, r.chunk_id, split_part(d.text, chr(10), 1) AS title,
    list_distinct_ordered AS ws
  FROM ranked r JOIN documents d ON d.doc_id = r.chunk_id
  JOIN (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) >= 2) AS list_distinct_ordered FROM benchmark) b
    ON b.item_id = r.query_id WHERE r.rank <= 30)
SELECT query_id, chunk_id, regexp_replace(title, '(' || array_to_string(list_transform(ws, lambda w: regexp_escape(w)), '|') || ')', '<mark>\\1</mark>', 'gi') AS title FROM k""",
    "point_ids": """
WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('chunk:' || doc_id)) AS d FROM documents)
SELECT doc_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-'
  || translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS point_id FROM h""",
    "embedding_search": "WITH" + EMBED_TEXT + """
, r AS (SELECT query_id, lang || ':' || doc_id || ':0001' AS chunk_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lang || ':' || doc_id || ':0001') AS rank FROM ecos)
SELECT query_id, chunk_id, rank, round(score, 5) AS score FROM r WHERE rank <= 10""",
}
