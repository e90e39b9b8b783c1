"""SQL statements of the registered quality queries, for a second engine."""

from __future__ import annotations

from fathomtext.registered.corpus_sql import PAGES
from fathomtext.registered.retrieval_sql import FUSED, GRAMS, SEVEN_ARMS, TERMS

ARMS = TERMS + "," + GRAMS + FUSED + """
, res AS (
  SELECT 'terms' AS arm, query_id, rank, chunk_id FROM ranked WHERE rank <= 10
  UNION ALL SELECT 'trigram', query_id, rank, chunk_id FROM granked WHERE rank <= 10
  UNION ALL (SELECT 'lexical', query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC,
      CASE WHEN terms_rank IS NULL THEN 1 ELSE 0 END, coalesce(terms_rank, trigram_rank)) AS rank, chunk_id
    FROM fused QUALIFY rank <= 10))
"""
TRUTH = """
, truth AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, 2 + coalesce(l.quality, 0) AS grade
  FROM documents d JOIN benchmark b ON contains(d.text, b.text) LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""
METRICS = ARMS + TRUTH + """
, j AS (SELECT query_id, count(*) AS judged FROM truth GROUP BY ALL)
, g AS (SELECT r.*, coalesce(t.grade, 0) AS grade FROM res r LEFT JOIN truth t USING (query_id, chunk_id))
, best AS (SELECT arm, query_id, grade, row_number() OVER (PARTITION BY arm, query_id ORDER BY grade DESC) AS pos FROM g)
, idl AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS pos FROM truth QUALIFY pos <= 10)
, bi AS (SELECT arm, query_id, sum((2 ** grade - 1) / log2(pos + 1)) AS idcg FROM best GROUP BY ALL)
, ti AS (SELECT query_id, sum((2 ** grade - 1) / log2(pos + 1)) AS tdcg FROM idl GROUP BY ALL)
, mm AS (SELECT arm, query_id,
    max((grade >= 2 AND rank <= 1)::INT)::BIGINT AS hit1, max((grade >= 2 AND rank <= 3)::INT)::BIGINT AS hit3,
    max((grade >= 2 AND rank <= 5)::INT)::BIGINT AS hit5,
    sum((grade >= 2 AND rank <= 5)::INT) AS f5, sum((grade >= 2 AND rank <= 10)::INT) AS f10,
    round(coalesce(1.0::DOUBLE / min(CASE WHEN grade >= 2 THEN rank END), 0), 3) AS mrr,
    sum((2 ** grade - 1) / log2(rank + 1)) AS dcg FROM g GROUP BY ALL)
, met AS (SELECT mm.arm, mm.query_id, hit1, hit3, hit5,
    coalesce(round(f5 / judged, 3), 0)::DOUBLE AS recall5, coalesce(round(f10 / judged, 3), 0)::DOUBLE AS recall10, mrr,
    round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 3)::DOUBLE AS ndcg,
    round(CASE WHEN tdcg > 0 THEN dcg / tdcg ELSE 0 END, 3)::DOUBLE AS ndcg_true
  FROM mm LEFT JOIN j USING (query_id) LEFT JOIN bi USING (arm, query_id) LEFT JOIN ti USING (query_id))
, summ AS (SELECT arm, count(*) AS n, round(avg(hit1), 3) AS hit1, round(avg(hit3), 3) AS hit3, round(avg(hit5), 3) AS hit5,
    round(avg(recall5), 3) AS recall5, round(avg(recall10), 3) AS recall10, round(avg(mrr), 3) AS mrr, round(avg(ndcg), 3) AS ndcg FROM met GROUP BY arm)
, typ AS (SELECT CASE WHEN length(b.text) < 250 THEN 'exact' ELSE 'semantic' END AS type, arm, count(*) AS n,
    round(avg(hit5), 3) AS hit5, round(avg(mrr), 3) AS mrr FROM met JOIN benchmark b ON b.item_id = met.query_id GROUP BY ALL)
"""
KEYWORDS = """
, kw0 AS (SELECT item_id AS query_id, unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM benchmark)
, kw AS (SELECT DISTINCT query_id, w FROM kw0)
, kt AS (SELECT DISTINCT kw.query_id, d.doc_id AS chunk_id FROM kw JOIN documents d ON contains(d.text, kw.w))
"""

SEVEN = SEVEN_ARMS + """
, res AS (SELECT arm, query_id, rank, split_part(chunk_id, ':', 2)::BIGINT AS chunk_id FROM arms)
"""
SEVEN_METRICS = SEVEN + METRICS.removeprefix(ARMS)

SQL = {
    "retrieval_metrics": METRICS + "SELECT * FROM met",
    "metrics_by_arm": METRICS + "SELECT * FROM summ",
    "metrics_by_type": METRICS + "SELECT * FROM typ",
    "quality_gates": METRICS + """
, b AS (SELECT max(hit5) AS hit5, max(mrr) AS mrr, max(ndcg) AS ndcg FROM summ)
, gt AS (SELECT 'hit5' AS gate, hit5 AS value, 0.9::DOUBLE AS threshold FROM b UNION ALL SELECT 'mrr', mrr, 0.75 FROM b
  UNION ALL SELECT 'ndcg', ndcg, 0.8 FROM b
  UNION ALL SELECT type || '_hit5', hit5, CASE type WHEN 'exact' THEN 0.95 ELSE 0.85 END FROM typ WHERE arm = 'lexical')
SELECT gate, value, threshold, value >= threshold AS passed FROM gt""",
    "best_arm": METRICS + """SELECT arm AS best_arm FROM summ
ORDER BY ndcg DESC, CASE arm WHEN 'terms' THEN 1 WHEN 'trigram' THEN 2 ELSE 3 END LIMIT 1""",
    "ab_compare": METRICS + """
SELECT a.query_id, a.hit5 AS hit5_a, a.mrr AS mrr_a, a.ndcg AS ndcg_a, b.hit5 AS hit5_b, b.mrr AS mrr_b, b.ndcg AS ndcg_b,
  b.hit5 - a.hit5 AS hit5_diff, round(b.mrr - a.mrr, 3) AS mrr_diff, round(b.ndcg - a.ndcg, 3) AS ndcg_diff
FROM met a JOIN met b USING (query_id) WHERE a.arm = 'terms' AND b.arm = 'lexical'""",
    "no_regression": METRICS + """
SELECT b.hit5 >= a.hit5 AND b.mrr >= a.mrr - 0.05 AS passed FROM summ a, summ b WHERE a.arm = 'terms' AND b.arm = 'lexical'""",
    "seven_arms": SEVEN_ARMS + "SELECT * FROM arms",
    "seven_arm_metrics": SEVEN_METRICS + "SELECT * FROM summ",
    "short_run_metrics": SEVEN_METRICS + """
SELECT arm, query_id, hit1, hit3, hit5, recall5, recall10, mrr, ndcg FROM met
WHERE query_id IN (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 10)""",
    "failure_buckets": SEVEN_METRICS + """
, reach AS (SELECT al.query_id, bool_or(t.chunk_id IS NOT NULL) AS any_hit, bool_or(t.chunk_id IS NOT NULL AND al.rank <= 10) AS top10
  FROM al LEFT JOIN truth t ON t.query_id = al.query_id AND t.chunk_id = split_part(al.chunk_id, ':', 2)::BIGINT GROUP BY al.query_id)
, x AS (SELECT query_id, max(hit5) FILTER (arm = 'dense') AS dense, max(hit5) FILTER (arm = 'lexical') AS lexical,
    max(hit5) FILTER (arm = 'hybrid') AS hybrid, max(hit5) FILTER (arm = 'hybrid_boost') AS boost,
    max(hit5) FILTER (arm = 'hybrid_rerank') AS rerank, max(hit5) AS most FROM met GROUP BY query_id)
, c AS (SELECT x.*, CASE WHEN NOT coalesce(any_hit, false) THEN 'NO_RECALL' WHEN hybrid = 0 AND coalesce(top10, false) THEN 'BAD_FUSION'
    WHEN hybrid = 1 AND rerank = 0 THEN 'BAD_RERANK' WHEN hybrid = 1 AND boost = 0 THEN 'BOOST_HURT'
    WHEN dense = 0 THEN 'LOW_DENSE_RANK' ELSE 'LOW_LEXICAL_RANK' END AS cause,
  array_to_string(list_filter([CASE WHEN dense = 0 THEN 'dense' END, CASE WHEN lexical = 0 THEN 'lexical' END,
    CASE WHEN hybrid = 0 THEN 'hybrid' END, CASE WHEN rerank = 0 THEN 'hybrid_rerank' END], lambda a: a IS NOT NULL), ',') AS failing
  FROM x LEFT JOIN reach USING (query_id))
SELECT query_id, CASE WHEN most = 0 THEN cause WHEN failing = '' THEN 'OK' ELSE 'PARTIAL:' || failing END AS bucket, cause FROM c""",
    "source_reach": TERMS + TRUTH + """
SELECT r.query_id, max(t.chunk_id IS NOT NULL) AS any_hit, max(t.chunk_id IS NOT NULL AND rank <= 10) AS top10_hit
FROM ranked r LEFT JOIN truth t USING (query_id, chunk_id) WHERE rank <= 50 GROUP BY r.query_id""",
    "latency_percentiles": """
SELECT event_type, list_sort(list(value))[least(floor(count(*) * 0.5::DOUBLE)::BIGINT, count(*) - 1) + 1] AS p50,
  list_sort(list(value))[least(floor(count(*) * 0.95::DOUBLE)::BIGINT, count(*) - 1) + 1] AS p95 FROM events GROUP BY event_type""",
    "resolved_judgments": PAGES + """
SELECT document_id AS query_id, document_id || ':top1' AS section_id, 3::BIGINT AS grade FROM heads WHERE level > 0""",
    "distinct_document_ndcg": TERMS + """
, res AS (SELECT query_id, rank, source FROM ranked JOIN documents ON doc_id = chunk_id WHERE rank <= 10)
, rel AS (SELECT DISTINCT b.item_id AS query_id, source FROM documents d JOIN benchmark b ON contains(d.text, b.text))
, fl AS (SELECT r.*, rel.source IS NOT NULL AS rel FROM res r LEFT JOIN rel USING (query_id, source))
, fh AS (SELECT query_id, min(CASE WHEN rel THEN rank END) AS fh FROM fl GROUP BY ALL)
, un AS (SELECT query_id, source, min(rank) AS rank, bool_or(rel) AS rel FROM fl GROUP BY ALL)
, po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM un)
, dc AS (SELECT query_id, sum(CASE WHEN rel THEN 1.0::DOUBLE / log2(pos + 1) ELSE 0 END) AS dcg FROM po GROUP BY ALL)
, nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL)
, id AS (SELECT query_id, list_sum([1.0::DOUBLE / log2(i + 1) for i in range(1, least(n, 10) + 1)]) AS idcg FROM nr)
SELECT b.item_id AS query_id, coalesce((fh <= 1)::BIGINT, 0) AS hit1, coalesce((fh <= 3)::BIGINT, 0) AS hit3,
  coalesce((fh <= 5)::BIGINT, 0) AS hit5, round(coalesce(1.0::DOUBLE / fh, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6)::DOUBLE AS ndcg
FROM benchmark b LEFT JOIN fh ON fh.query_id = b.item_id LEFT JOIN dc ON dc.query_id = b.item_id LEFT JOIN id ON id.query_id = b.item_id""",
    "keyword_truth": "WITH one AS (SELECT 1)" + KEYWORDS + "SELECT * FROM kt",
    "keyword_metrics": ARMS + KEYWORDS + """
SELECT r.arm, r.query_id, max((kt.chunk_id IS NOT NULL AND rank <= 5)::INT)::BIGINT AS hit5,
  round(coalesce(1.0::DOUBLE / min(CASE WHEN kt.chunk_id IS NOT NULL THEN rank END), 0), 6) AS mrr
FROM res r LEFT JOIN kt USING (query_id, chunk_id) GROUP BY ALL""",
    "truth_with_fallback": ARMS + TRUTH + """
, good AS (SELECT DISTINCT query_id FROM res JOIN truth USING (query_id, chunk_id) WHERE arm = 'terms' AND rank <= 5)
SELECT query_id, chunk_id, rank, 'terms' AS mode FROM res WHERE arm = 'terms' AND rank <= 5 AND query_id IN (SELECT query_id FROM good)
UNION ALL SELECT query_id, chunk_id, rank, 'trigram' FROM res WHERE arm = 'trigram' AND rank <= 5 AND query_id NOT IN (SELECT query_id FROM good)""",
}
