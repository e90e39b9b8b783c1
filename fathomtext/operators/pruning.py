"""Exact top-k of weighted sums that scores only the pairs which can still win.

A query is a row of phrases with weights; a hit gives a phrase and a chunk an impact.  The score of
a chunk is the sum of weight times impact.  Most pairs of a query and a chunk come from
frequent phrases that add little, so they are not formed at all:

1. the phrases with the largest bounds are scored first, as many as it takes to see enough
   chunks; the k-th best sum so far is a floor for the query;
2. a query's phrases, by falling bound, split where the bounds of the rest add up to less than the
   floor: a chunk that only the rest hits cannot win;
3. chunks hit by the first part are scored on it; those whose sum plus all bounds of the
   rest lies below the floor, raised by now, are dropped;
4. what is left meets the rest of the phrases by (phrase, chunk).

All steps are joins and aggregations; nothing depends on the order of execution.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from fathomtext.functions.stats import top_rows
from fathomtext.sources.staging import staged

#: Sums within this distance of a floor are kept: floats add up in any order, and scores tie after rounding.
SLACK = 1e-7
#: Hits that the first pass sees at least for each result wanted, where a query has as many.
LEAD = 4


@dataclass
class Pruned:
    """The scores of all chunks that may be among the first ``k``, and the pairs that were formed for them."""

    scores: DataFrame
    first: DataFrame
    leading: DataFrame
    filled: DataFrame

    def scored_pairs(self) -> int:
        """Number of (query, phrase, chunk) products of all three passes."""
        return sum(p.count() for p in (self.first, self.leading, self.filled))


def _pairs(weights: DataFrame, impacts: DataFrame) -> DataFrame:
    return impacts.join(weights.select("query_id", "phrase", "w"), "phrase").select(
        "query_id", "chunk_id", (F.col("w") * F.col("part")).alias("product")
    )


def _sums(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("query_id", "chunk_id").agg(F.sum("product").alias("score"))


def _floors(sums: DataFrame, k: int) -> DataFrame:
    """The k-th best sum of each query that has as many."""
    best = top_rows(sums, ["query_id"], [F.desc("score")], k)
    return best.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")


def pruned_scores(weights: DataFrame, impacts: DataFrame, k: int, lead: int = LEAD) -> Pruned:
    """Scores of a batch of queries, without the chunks that cannot be among the first ``k``.

    ``weights(query_id, phrase, w, bound, df)`` has one row for each phrase of a query: its weight, the most it can add
    to a score and the number of chunks it hits.  ``impacts(phrase, chunk_id, part)`` has one row for each hit, weights
    and parts are not negative.  A query with fewer than ``k`` hits keeps all of them.
    """
    falling = Window.partitionBy("query_id").orderBy(F.desc("bound"), F.asc("phrase"))
    before = falling.rowsBetween(Window.unboundedPreceding, -1)
    onwards = falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    split = staged(
        weights.withColumn("seen", F.coalesce(F.sum("df").over(before), F.lit(0))).withColumn("tail", F.sum("bound").over(onwards)),
        "search",
    )
    first = _pairs(split.where(F.col("seen") < lead * k), impacts)
    floors = staged(_floors(_sums(first), k), "search")
    marked = split.join(floors, "query_id", "left").withColumn(
        "leads", F.col("floor").isNull() | (F.col("tail") >= F.col("floor") - SLACK)
    )
    leading = _pairs(marked.where("leads"), impacts)
    partial = staged(_sums(leading), "search")
    rest = marked.where("NOT leads")
    missing = rest.groupBy("query_id").agg(F.sum("bound").alias("missing"))
    raised = _floors(partial, k).unionByName(floors).groupBy("query_id").agg(F.max("floor").alias("floor"))
    can_win = (
        partial.join(missing, "query_id", "left").join(raised, "query_id", "left")
        .where(F.col("floor").isNull() | (F.col("score") + F.coalesce("missing", F.lit(0.0)) >= F.col("floor") - SLACK))
        .select("query_id", "chunk_id", "score")
    )
    kept = staged(can_win, "search")
    filled = impacts.join(
        kept.select("query_id", "chunk_id").join(rest.select("query_id", "phrase", "w"), "query_id"), ["phrase", "chunk_id"]
    ).select("query_id", "chunk_id", (F.col("w") * F.col("part")).alias("product"))
    more = _sums(filled).withColumnRenamed("score", "more")
    scores = kept.join(more, ["query_id", "chunk_id"], "left").select(
        "query_id", "chunk_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")
    )
    return Pruned(scores, first, leading, filled)
