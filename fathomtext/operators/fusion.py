"""Rank fusion, section boost, filters and cuts of a ranked list.

Ranked lists are long tables ``query_id, source, item_id, rank``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from fathomtext.functions.stats import top_rows

# Fusion constant, weights per source and the parent boost.
RRF_K = 60
SOURCE_WEIGHTS = {"dense": 1.0, "terms": 0.9, "trigram": 0.7}
PARENT_BOOST = 1.08


@dataclass(frozen=True)
class SearchFilters:
    """Conjunctive filters; an empty list or None does not filter."""

    document_ids: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)
    evidence_levels: list[int] = field(default_factory=list)
    content_types: list[str] = field(default_factory=list)
    date_from: str | None = None
    date_to: str | None = None

    def condition(self) -> Column | None:
        """One predicate over chunk columns joined with document columns."""
        out = None
        tests = [
            ("document_id", self.document_ids),
            ("domain", self.domains),
            ("evidence_level", self.evidence_levels),
            ("content_type", self.content_types),
        ]
        for name, values in tests:
            if values:
                test = F.col(name).isin(*values)
                out = test if out is None else out & test
        if self.date_from:
            test = F.col("completed_at") >= self.date_from
            out = test if out is None else out & test
        if self.date_to:
            test = F.col("completed_at") <= self.date_to
            out = test if out is None else out & test
        return out


def rrf(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion.

    Gives ``query_id, item_id, rrf, ranks, first_source, first_rank``; ``ranks``
    maps every source to a rank or null.  The sum is taken in the order of
    ``weights``, so equal candidates get equal scores, and ties fall to the
    earlier source and the better rank in it.
    """
    weights = weights or SOURCE_WEIGHTS
    by_source = lists.where(F.col("source").isin(*weights)).groupBy("query_id", "item_id").agg(
        *[F.min(F.when(F.col("source") == s, F.col("rank"))).alias(f"_{s}") for s in weights]
    )
    score = F.lit(0.0)
    for s, w in weights.items():
        score = score + F.coalesce(F.lit(float(w)) / (k + F.col(f"_{s}")), F.lit(0.0))
    first = F.coalesce(
        *[F.when(F.col(f"_{s}").isNotNull(), F.lit(i)) for i, s in enumerate(weights)]
    )
    return by_source.select(
        "query_id",
        "item_id",
        score.alias("rrf"),
        F.map_from_arrays(
            F.array(*[F.lit(s) for s in weights]), F.array(*[F.col(f"_{s}") for s in weights])
        ).alias("ranks"),
        first.alias("first_source"),
        F.coalesce(*[F.col(f"_{s}") for s in weights]).alias("first_rank"),
    )


def ancestor_ids(item_id: Column) -> Column:
    """All proper ``:``-prefixes of an id."""
    parts = F.split(item_id, ":")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, 1, i), ":"),
    )


def parent_boost(fused: DataFrame, section_hits: DataFrame, boost: float = PARENT_BOOST) -> DataFrame:
    """Multiply the score of items below a hit section.

    ``section_hits(query_id, section_key)`` names sections as
    ``{document}:{section}``.  A prefix test becomes an equi-join on the few
    ancestors of each item.
    """
    below = (
        fused.select("query_id", "item_id", F.explode(ancestor_ids(F.col("item_id"))).alias("section_key"))
        .join(section_hits.select("query_id", "section_key").distinct(), ["query_id", "section_key"], "left_semi")
        .select("query_id", "item_id")
        .distinct()
        .withColumn("section_boost", F.lit(float(boost)))
    )
    return (
        fused.join(below, ["query_id", "item_id"], "left")
        .withColumn("section_boost", F.coalesce("section_boost", F.lit(1.0)))
        .withColumn("final", F.col("rrf") * F.col("section_boost"))
    )


def without_boost(fused: DataFrame) -> DataFrame:
    return fused.withColumn("section_boost", F.lit(1.0)).withColumn("final", F.col("rrf"))


def keep_allowed(
    fused: DataFrame, chunks: DataFrame, documents: DataFrame, filters: SearchFilters | None
) -> DataFrame:
    """Keep candidates whose chunk and document satisfy every filter."""
    condition = filters.condition() if filters else None
    if condition is None:
        return fused
    allowed = (
        chunks.select(F.col("id").alias("item_id"), "document_id", "content_type", "evidence_level")
        .join(documents.select(F.col("id").alias("document_id"), "domain", "completed_at"), "document_id", "left")
        .where(condition)
        .select("item_id")
    )
    return fused.join(allowed, "item_id", "left_semi")


def fused_top(scored: DataFrame, k: int = 30, rank_col: str = "pre_rank") -> DataFrame:
    """Order by final score, then source and rank, and keep ``k`` per query."""
    order = [F.desc("final"), F.asc("first_source"), F.asc("first_rank"), F.asc("item_id")]
    return top_rows(scored, ["query_id"], order, k, rank_col)


def with_chunk_rows(top: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Attach chunk columns and the title; items the catalog lacks fall out."""
    rows = chunks.select(
        F.col("id").alias("item_id"), "document_id", "section_id", "heading_path", "content_type",
        "evidence_level", "plain_text", "start_line", "end_line",
    )
    titles = documents.select(F.col("id").alias("document_id"), "title")
    return top.join(rows, "item_id").join(titles, "document_id", "left")


def reranked(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """New order by rerank score; candidates without a score sink, in old order.

    Adds ``reranker`` and the order columns used by ``final_top``.
    """
    return candidates.join(scores.select("query_id", "item_id", "reranker"), ["query_id", "item_id"], "left")


def final_top(candidates: DataFrame, k: int = 10, use_reranker: bool = False) -> DataFrame:
    order = [F.asc("pre_rank")]
    if use_reranker:
        order = [F.desc_nulls_last("reranker"), F.asc("pre_rank")]
    return top_rows(candidates, ["query_id"], order, k)
