"""Registered queries: lexical, vector and fused retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomtext.functions.text import TermTrie, highlight, identifiers, rerank_text, snippet, terms
from fathomtext.functions.stats import top_rows
from fathomtext.operators import dense, fusion, lexical
from fathomtext.operators.fusion import SearchFilters
from fathomtext.plans.search import CorpusIndex, SearchOptions, overlap_score, rerank_scores, search
from fathomtext.registered import inputs


def bm25_terms_topk(spark, sf_dir) -> DataFrame:
    return inputs.terms_list(spark, sf_dir, 10).select(
        "query_id", "chunk_id", "rank", F.round("score", 6).alias("score")
    )


def substring_truth(spark, sf_dir) -> DataFrame:
    return inputs.truth(spark, sf_dir).select("query_id", "chunk_id")


def trigram_bm25_topk(spark, sf_dir) -> DataFrame:
    return inputs.grams_list(spark, sf_dir, 30).select(
        "query_id", "chunk_id", "rank", F.round("score", 6).alias("score")
    )


def identifier_extract(spark, sf_dir) -> DataFrame:
    pages = inputs.table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("t"))
    docs = inputs.table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    return pages.unionByName(docs).select(
        "kind", "id", F.posexplode(identifiers(F.col("t"))).alias("pos", "identifier")
    ).select("kind", "id", (F.col("pos") + 1).alias("pos"), "identifier")


#: A rule that turns the letters of the documents into characters of one long run, and terms made by it.
LETTERS, SIGNS = "abcdefghijklmnopqrstuvwxyz", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥乾坎艮震"
DOMAIN_TERMS = ["the", "th", "tion", "ion", "ent", "and", "ande", "ing", "eau", "ein", "eit", "os", "que", "quement", "is", "istion"]


def domain_terms(spark, sf_dir) -> DataFrame:
    """Terms of every document written in other signs, by the longest listed terms."""
    trie = TermTrie(t.translate(str.maketrans(LETTERS, SIGNS)) for t in DOMAIN_TERMS)
    signs = F.translate(F.translate(F.lower("text"), LETTERS, SIGNS), " ", "")
    d = inputs.table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(signs, F.lit(f"[{SIGNS}]+"), 0).alias("runs"))
    each = d.select("doc_id", F.posexplode("runs").alias("run", "t"))
    return each.select("doc_id", (F.col("run") + 1).alias("run"), terms(F.col("t"), trie).alias("ts")).select(
        "doc_id", "run", F.size("ts").alias("n"), F.md5(F.array_join("ts", " ")).alias("digest")
    )


def lexical_fusion(spark, sf_dir) -> DataFrame:
    q = inputs.queries(spark, sf_dir)
    fused = lexical.search_lexical(lexical.query_phrases(q), lexical.query_substrings(q), *inputs.lexical_index(spark, sf_dir))
    return fused.select(
        "query_id",
        F.col("item_id").alias("chunk_id"),
        F.round("rrf", 8).alias("rrf"),
        F.element_at("ranks", F.lit("terms")).alias("terms_rank"),
        F.element_at("ranks", F.lit("trigram")).alias("trigram_rank"),
    )


def _label_vectors(spark, sf_dir) -> DataFrame:
    return inputs.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("evidence_level"))


def cosine_topk(spark, sf_dir) -> DataFrame:
    hits = dense.cosine_topk(_label_vectors(spark, sf_dir), inputs.label_centroids(spark, sf_dir), 50, id_col="vec_id")
    return hits.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def cosine_topk_filtered(spark, sf_dir) -> DataFrame:
    kept = dense.prefiltered(_label_vectors(spark, sf_dir), SearchFilters(evidence_levels=[1, 2, 3]))
    hits = dense.cosine_topk(kept, inputs.label_centroids(spark, sf_dir), 20, id_col="vec_id")
    return hits.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def rrf_fusion(spark, sf_dir) -> DataFrame:
    near = dense.cosine_topk(
        _label_vectors(spark, sf_dir), inputs.label_centroids(spark, sf_dir), 50, id_col="vec_id"
    ).select("query_id", F.lit("dense").alias("source"), F.col("vec_id").alias("item_id"), "rank")
    own = top_rows(
        _label_vectors(spark, sf_dir).select(F.col("evidence_level").alias("query_id"), F.col("vec_id").alias("item_id"), F.get("embedding", F.lit(0)).alias("x")),
        ["query_id"], [F.desc("x"), F.asc("item_id")], 50,
    ).select("query_id", F.lit("terms").alias("source"), "item_id", "rank")
    fused = fusion.rrf(near.unionByName(own))
    return fused.select(
        "query_id", "item_id", F.round("rrf", 8).alias("rrf"),
        F.element_at("ranks", F.lit("dense")).alias("dense_rank"),
        F.element_at("ranks", F.lit("terms")).alias("terms_rank"),
        F.element_at("ranks", F.lit("trigram")).alias("trigram_rank"),
        "first_source", "first_rank",
    )


def prefix_boost(spark, sf_dir) -> DataFrame:
    c = inputs.table(spark, sf_dir, "conversations")
    item = F.concat_ws(":", F.col("conv_id").cast("string"), "role", F.format_string("%04d", "turn"))
    fused = c.select(
        F.col("conv_id").alias("query_id"), item.alias("item_id"), (1.0 / (60 + F.col("turn") + 1)).alias("rrf")
    )
    loudest = c.groupBy("conv_id", "role").agg(F.sum(F.length("text")).alias("n")).groupBy("conv_id").agg(
        F.max_by("role", F.struct("n", "role")).alias("role")
    )
    hits = loudest.select(
        F.col("conv_id").alias("query_id"), F.concat_ws(":", F.col("conv_id").cast("string"), "role").alias("section_key")
    )
    return fusion.parent_boost(fused, hits).select(
        "query_id", "item_id", "section_boost", F.round("final", 9).alias("final")
    )


def _terms_candidates(spark, sf_dir, k: int, filters: SearchFilters | None, fused_k: int) -> DataFrame:
    lists = inputs.terms_list(spark, sf_dir, k).select(
        "query_id", F.lit("terms").alias("source"), F.col("chunk_id").alias("item_id"), "rank"
    )
    chunks, documents = inputs.document_chunks(spark, sf_dir), inputs.document_rows(spark, sf_dir)
    scored = fusion.without_boost(fusion.rrf(lists))
    allowed = fusion.keep_allowed(scored, chunks, documents, filters)
    return fusion.with_chunk_rows(fusion.fused_top(allowed, fused_k), chunks, documents)


FILTERED = SearchFilters(content_types=["en", "de", "es"], domains=[f"src{i}" for i in range(10)])


def filtered_fused_topk(spark, sf_dir) -> DataFrame:
    rows = _terms_candidates(spark, sf_dir, 50, FILTERED, 30)
    return fusion.final_top(rows, 10).select(
        "query_id", "rank", "pre_rank", F.col("item_id").alias("chunk_id"), "title",
        "content_type", F.round("final", 8).alias("final"),
    )


def result_snippets(spark, sf_dir) -> DataFrame:
    rows = _terms_candidates(spark, sf_dir, 50, None, 30).join(inputs.queries(spark, sf_dir), "query_id")
    return rows.select(
        "query_id", F.col("item_id").alias("chunk_id"), snippet(F.col("plain_text"), F.col("query")).alias("snippet")
    )


def rerank_reorder(spark, sf_dir) -> DataFrame:
    candidates = _terms_candidates(spark, sf_dir, 30, None, 30)
    scores = rerank_scores(candidates, inputs.queries(spark, sf_dir), 24)
    final = fusion.final_top(fusion.reranked(candidates, scores), 10, True)
    return final.select(
        "query_id", "rank", "pre_rank", F.col("item_id").alias("chunk_id"), F.round("reranker", 6).alias("reranker")
    )


def rerank_inputs(spark, sf_dir) -> DataFrame:
    rows = _terms_candidates(spark, sf_dir, 50, None, 30).join(inputs.queries(spark, sf_dir), "query_id")
    text = rerank_text(
        F.col("query"), F.col("title"), F.col("heading_path"), F.col("content_type"), F.col("evidence_level"), F.col("plain_text")
    )
    return rows.select("query_id", F.col("item_id").alias("chunk_id"), text.alias("document"))


def highlighted_titles(spark, sf_dir) -> DataFrame:
    rows = _terms_candidates(spark, sf_dir, 50, None, 30).join(inputs.queries(spark, sf_dir), "query_id")
    marked = highlight(F.col("title"), F.col("query"))
    return rows.select("query_id", F.col("item_id").alias("chunk_id"), marked.alias("title"))


def point_ids(spark, sf_dir) -> DataFrame:
    d = inputs.table(spark, sf_dir, "documents")
    return d.select("doc_id", dense.point_id(F.col("doc_id").cast("string")).alias("point_id"))


def corpus_index(spark, sf_dir) -> CorpusIndex:
    """Documents as a searchable corpus, one section per language and source."""
    named = lambda doc: F.concat_ws(":", "content_type", F.col(doc).cast("string"), F.lit("0001"))
    chunks = inputs.document_chunks(spark, sf_dir).withColumn("id", named("document_id"))
    terms, grams = inputs.lexical_index(spark, sf_dir, named("chunk_id"))
    vectors = chunks.select(
        F.col("id").alias("chunk_id"), dense.hashed_embedding(F.col("plain_text")).alias("embedding")
    )
    first_lines = inputs.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("document_id"),
        F.col("doc_id").cast("string").alias("section_id"),
        dense.hashed_embedding(F.substring_index("text", "\n", 1)).alias("embedding"),
    )
    return CorpusIndex(
        chunks=chunks,
        documents=inputs.document_rows(spark, sf_dir),
        terms=terms,
        grams=grams,
        vectors=vectors,
        section_vectors=first_lines,
    )


def query_vectors(spark, sf_dir) -> DataFrame:
    return inputs.queries(spark, sf_dir).select("query_id", dense.hashed_embedding(F.col("query")).alias("embedding"))


def hybrid_search(spark, sf_dir) -> DataFrame:
    out = search(
        inputs.queries(spark, sf_dir), corpus_index(spark, sf_dir), query_vectors(spark, sf_dir), SearchOptions(top_k=10)
    )
    return out.select(
        "query_id", "rank", "chunk_id", "dense_rank", "terms_rank", "trigram_rank", "rrf", "section_boost", "final"
    )


def embedding_search(spark, sf_dir) -> DataFrame:
    index = corpus_index(spark, sf_dir)
    hits = dense.cosine_topk(index.vectors, query_vectors(spark, sf_dir), 10)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_terms_topk, domain_terms, substring_truth, trigram_bm25_topk, identifier_extract, lexical_fusion, cosine_topk,
        cosine_topk_filtered, rrf_fusion, prefix_boost, filtered_fused_topk, result_snippets, rerank_reorder,
        rerank_inputs, highlighted_titles, point_ids, hybrid_search, embedding_search,
    )
}

__all__ = ["QUERIES", "corpus_index", "overlap_score", "query_vectors"]
