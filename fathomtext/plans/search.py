"""Batch search: ranked lists per source, fusion, boost, filters, rerank, cut."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from fathomtext.functions.stats import top_rows
from fathomtext.functions.text import TermTrie, rerank_text, snippet, words
from fathomtext.operators import dense, fusion, lexical
from fathomtext.operators.fusion import SearchFilters
from fathomtext.sources.staging import staged

MODES = {"dense": ("dense",), "lexical": ("terms", "trigram"), "hybrid": ("dense", "terms", "trigram")}


@dataclass
class CorpusIndex:
    """Tables of one corpus, as built by ``plans.indexing`` or read back."""

    chunks: DataFrame
    documents: DataFrame
    terms: lexical.TermIndex
    grams: lexical.GramIndex
    vectors: DataFrame
    section_vectors: DataFrame | None = None
    domain_terms: Column | TermTrie | None = None


@dataclass(frozen=True)
class SearchOptions:
    """Default list sizes."""

    mode: str = "hybrid"
    top_k: int = 10
    dense_k: int = 50
    terms_k: int = 50
    grams_k: int = 30
    fused_k: int = 30
    rerank_k: int = 24
    boost_sections: int = 8
    boost: float = fusion.PARENT_BOOST
    use_boost: bool = True
    rerank: bool = False
    filters: SearchFilters | None = None

    def checked(self) -> SearchOptions:
        if self.mode not in MODES:
            raise ValueError(f"unknown search mode {self.mode!r}")
        if not 1 <= self.top_k <= 50:
            raise ValueError("top_k must lie between 1 and 50")
        return self


def valid_queries(queries: DataFrame, max_chars: int = 500) -> tuple[DataFrame, DataFrame]:
    """Split a query table into accepted rows and rejected rows with a reason."""
    n = F.length(F.coalesce("query", F.lit("")))
    reason = F.when(n == 0, "empty").when(n > max_chars, "too_long")
    marked = queries.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def overlap_score(query: Column, document: Column) -> Column:
    """Default rerank score: share of the query's words found in the document."""
    asked = F.array_distinct(words(query))
    found = F.array_intersect(asked, words(document))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(found) / F.size(asked))


def model_score(make_predict: Callable[[], Callable], batch_size: int = 8) -> Callable[[Column, Column], Column]:
    """Rerank scorer from a model the caller supplies, batched on the executors."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    udf = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_size)
    return lambda query, document: udf(query, document)


def source_lists(
    queries: DataFrame, query_vectors: DataFrame | None, index: CorpusIndex, options: SearchOptions
) -> DataFrame:
    """The ranked lists of the mode's sources as one long table with scores."""
    options.checked()
    sources = MODES[options.mode]
    parts = []
    if "dense" in sources:
        vectors = dense.prefiltered(index.vectors, options.filters)
        parts.append(("dense", dense.cosine_topk(vectors, query_vectors, options.dense_k)))
    if "terms" in sources:
        parts.append(("terms", lexical.search_terms(lexical.query_phrases(queries, known=index.domain_terms), index.terms, options.terms_k)))
    if "trigram" in sources:
        parts.append(
            ("trigram", lexical.search_substrings(lexical.query_substrings(queries, known=index.domain_terms), index.grams, options.grams_k))
        )
    out = None
    for name, hits in parts:
        rows = hits.select(
            "query_id", F.lit(name).alias("source"), F.col("chunk_id").alias("item_id"), "rank", "score"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def hit_sections(query_vectors: DataFrame, index: CorpusIndex, k: int = 8) -> DataFrame:
    """Best sections per query as ``query_id, section_key``."""
    sections = index.section_vectors.withColumn(
        "section_key", F.concat_ws(":", "document_id", "section_id")
    )
    return dense.cosine_topk(sections, query_vectors, k, id_col="section_key").select("query_id", "section_key", "rank")


def fused_candidates(
    lists: DataFrame, query_vectors: DataFrame | None, index: CorpusIndex, options: SearchOptions
) -> DataFrame:
    """Fused, boosted, filtered and cut candidates with their catalog rows."""
    fused = fusion.rrf(lists)
    boosts = options.use_boost and options.mode == "hybrid" and index.section_vectors is not None
    if boosts:
        scored = fusion.parent_boost(fused, hit_sections(query_vectors, index, options.boost_sections), options.boost)
    else:
        scored = fusion.without_boost(fused)
    allowed = fusion.keep_allowed(scored, index.chunks, index.documents, options.filters)
    return fusion.with_chunk_rows(fusion.fused_top(allowed, options.fused_k), index.chunks, index.documents)


def rerank_scores(
    candidates: DataFrame, queries: DataFrame, limit: int = 24,
    scorer: Callable[[Column, Column], Column] = overlap_score,
) -> DataFrame:
    """Scores of the first ``limit`` candidates of each query."""
    sent = top_rows(candidates, ["query_id"], [F.asc("pre_rank")], limit, "_sent")
    document = rerank_text(
        F.col("query"), F.col("title"), F.col("heading_path"), F.col("content_type"),
        F.col("evidence_level"), F.col("plain_text"),
    )
    return (
        sent.join(queries.select("query_id", "query"), "query_id")
        .withColumn("document", document)
        .select("query_id", "item_id", scorer(F.col("query"), F.col("document")).alias("reranker"))
    )


def search(
    queries: DataFrame,
    index: CorpusIndex,
    query_vectors: DataFrame | None = None,
    options: SearchOptions = SearchOptions(),
    scorer: Callable[[Column, Column], Column] = overlap_score,
    corpus: str | None = None,
) -> DataFrame:
    """Ranked results of a query batch ``queries(query_id, query)``.

    A second corpus is searched by the same plan over its own tables; ``corpus``
    tags the rows, and such a corpus has no section vectors and so no boost.
    """
    options = options.checked()
    lists = source_lists(queries, query_vectors, index, options)
    candidates = fused_candidates(lists, query_vectors, index, options)
    if options.rerank:
        scores = rerank_scores(candidates, queries, options.rerank_k, scorer)
        candidates = fusion.reranked(candidates, scores)
    else:
        candidates = candidates.withColumn("reranker", F.lit(None).cast("double"))
    final = fusion.final_top(candidates, options.top_k, options.rerank)
    out = final.join(queries.select("query_id", "query"), "query_id").select(
        "query_id",
        "rank",
        F.col("item_id").alias("chunk_id"),
        "document_id",
        "title",
        "section_id",
        "heading_path",
        "content_type",
        "evidence_level",
        snippet(F.col("plain_text"), F.col("query")).alias("snippet"),
        "start_line",
        "end_line",
        F.element_at("ranks", F.lit("dense")).alias("dense_rank"),
        F.element_at("ranks", F.lit("terms")).alias("terms_rank"),
        F.element_at("ranks", F.lit("trigram")).alias("trigram_rank"),
        F.round("rrf", 6).alias("rrf"),
        "section_boost",
        F.round("final", 6).alias("final"),
        F.round("reranker", 4).alias("reranker"),
        F.when(F.lit(options.rerank), F.col("pre_rank")).alias("pre_rerank_rank"),
    )
    return out.withColumn("corpus", F.lit(corpus)) if corpus else out


def trace(
    queries: DataFrame, index: CorpusIndex, query_vectors: DataFrame | None = None,
    options: SearchOptions = SearchOptions(), scorer: Callable[[Column, Column], Column] = overlap_score,
) -> dict[str, DataFrame]:
    """How a result came about: sources, boosted sections, fused top, rerank."""
    lists = source_lists(queries, query_vectors, index, options)
    out = {
        "sources": lists.where(F.col("rank") <= 10),
        "candidates_before_filter": lists.groupBy("query_id").agg(F.countDistinct("item_id").alias("n")),
    }
    candidates = fused_candidates(lists, query_vectors, index, options)
    if options.use_boost and options.mode == "hybrid" and index.section_vectors is not None:
        out["boosted_sections"] = hit_sections(query_vectors, index, options.boost_sections)
    if options.rerank:
        scores = rerank_scores(candidates, queries, options.rerank_k, scorer)
        out["rerank"] = scores.join(candidates.select("query_id", "item_id", "pre_rank"), ["query_id", "item_id"])
        candidates = fusion.reranked(candidates, scores)
        ordered = fusion.final_top(candidates, 20, True)
    else:
        ordered = fusion.final_top(candidates, 20)
    out["fused_top"] = ordered.select("query_id", "rank", "item_id", "ranks", F.round("rrf", 6).alias("rrf"), "section_boost")
    return out


def facet_values(documents: DataFrame) -> DataFrame:
    """Distinct non-empty domains in order."""
    return documents.where(F.coalesce("domain", F.lit("")) != "").select("domain").distinct().orderBy("domain")


ARMS = ("terms", "trigram", "lexical", "dense", "hybrid", "hybrid_boost", "hybrid_rerank")


def arms(
    queries: DataFrame, index: CorpusIndex, query_vectors: DataFrame, options: SearchOptions = SearchOptions(),
    scorer: Callable[[Column, Column], Column] = overlap_score, k: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """The first ``k`` of all seven arms as ``arm, query_id, rank, chunk_id``, and the source lists they come from.

    Each source is searched once and its list written; every arm branches from these lists, and both arms
    with a boost from one list of boosted candidates.
    """
    options = replace(options, mode="hybrid", use_boost=True, rerank=False).checked()
    lists = staged(source_lists(queries, query_vectors, index, options), "arms")
    boosted = staged(fused_candidates(lists, query_vectors, index, options), "arms")
    plain = fused_candidates(lists, None, index, replace(options, use_boost=False))
    lexical_only = fusion.fused_top(fusion.without_boost(fusion.rrf(lists.where(F.col("source") != "dense"))), k, "rank")
    again = fusion.reranked(boosted, rerank_scores(boosted, queries, options.rerank_k, scorer))
    ranked = {
        **{source: lists.where((F.col("source") == source) & (F.col("rank") <= k)) for source in ("terms", "trigram", "dense")},
        "lexical": lexical_only,
        "hybrid": fusion.final_top(plain, k),
        "hybrid_boost": fusion.final_top(boosted, k),
        "hybrid_rerank": fusion.final_top(again, k, True),
    }
    out = None
    for arm in ARMS:
        rows = ranked[arm].select(F.lit(arm).alias("arm"), "query_id", "rank", F.col("item_id").alias("chunk_id"))
        out = rows if out is None else out.unionByName(rows)
    return out, lists
