"""Retrieval quality: judgments, metrics, roll-ups, gates and failure causes.

Results of all arms live in one table ``arm, query_id, rank, section_id`` (or
``document_id``); judgments are rows ``query_id, section_id, grade``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomtext.functions.stats import nearest_rank, top_rows
from fathomtext.operators import scanning
from fathomtext.operators.lexical import GramIndex, gram_index, substring_truth
from fathomtext.sources.staging import staged

# The grade from which a result counts as relevant, and the gates.
RELEVANT = 2
HYBRID_ARMS = ("hybrid", "hybrid_boost", "hybrid_rerank")
GATES = {"hit5": 0.90, "mrr": 0.75, "ndcg": 0.80}
TYPE_GATES = {"exact": 0.95, "semantic": 0.85}


def resolve_judgments(judged: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections of a document whose heading or path holds the judged words.

    ``judged(query_id, document_id, heading_contains, grade)``.  ASCII case is
    ignored; the words are taken literally.  A section judged twice stays twice.
    """
    j = judged.select("query_id", "document_id", F.lower("heading_contains").alias("words"), "grade")
    s = sections.select("document_id", F.col("id").alias("section_id"), "heading", "heading_path")
    holds = F.contains(F.lower("heading"), F.col("words")) | F.contains(F.lower("heading_path"), F.col("words"))
    return j.join(s, "document_id").where(holds).select("query_id", "section_id", "grade")


def section_and_ancestors(section_id: Column) -> Column:
    """The section id and its proper ``:``-prefixes."""
    parts = F.split(section_id, ":")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ":"))


def graded(results: DataFrame, judgments: DataFrame, keys: tuple[str, ...] = ("arm", "query_id")) -> DataFrame:
    """Results with ``grade`` and the judged sections they fall in.

    A result counts for a judged section equal to its own or above it.  Each
    result meets the judgments on the few ids of its ancestor chain.
    """
    best = judgments.groupBy("query_id", "section_id").agg(F.max("grade").alias("g"))
    hits = (
        results.select(*keys, "rank", F.explode(section_and_ancestors(F.col("section_id"))).alias("anc"))
        .join(best.withColumnRenamed("section_id", "anc"), ["query_id", "anc"])
        .groupBy(*keys, "rank")
        .agg(
            F.max("g").alias("g"),
            F.collect_set(F.when(F.col("g") >= RELEVANT, F.col("anc"))).alias("found"),
        )
    )
    return results.join(hits, [*keys, "rank"], "left").select(
        *results.columns,
        F.coalesce("g", F.lit(0)).alias("grade"),
        F.coalesce("found", F.array().cast("array<string>")).alias("found"),
    )


def _gain(grades: Column) -> Column:
    """Discounted gain of grades in the given order."""
    return F.aggregate(
        F.transform(grades, lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + F.lit(2.0))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def query_metrics(
    results: DataFrame, judgments: DataFrame, keys: tuple[str, ...] = ("arm", "query_id"), cutoff: int = 10
) -> DataFrame:
    """Hit, recall, reciprocal rank and NDCG of each query and arm.

    ``ndcg`` is normalized by the retrieved grades in their best order;
    ``ndcg_true`` by the best order of all judgments of the query.
    """
    g = graded(results.where(F.col("rank") <= cutoff), judgments, keys)
    rel = F.col("grade") >= RELEVANT
    per_query = g.groupBy(*keys).agg(
        *[F.max(F.when(rel & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hit{k}") for k in (1, 3, 5)],
        F.coalesce(1.0 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "grade"))), lambda x: x["grade"]
        ).alias("grades"),
        *[
            F.size(
                F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= k, F.col("found")))))
            ).alias(f"found{k}")
            for k in (5, 10)
        ],
    )
    judged = judgments.groupBy("query_id").agg(
        F.count_if(F.col("grade") >= RELEVANT).alias("judged"),
    )
    ideal = top_rows(judgments.select("query_id", "section_id", "grade"), ["query_id"], [F.desc("grade"), F.asc("section_id")], cutoff, "at")
    ideal = ideal.groupBy("query_id").agg(F.sort_array(F.collect_list("grade"), asc=False).alias("best"))
    idcg = _gain(F.sort_array("grades", asc=False))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return (
        per_query.join(judged, "query_id", "left")
        .join(ideal, "query_id", "left")
        .select(
            *keys,
            "hit1", "hit3", "hit5",
            *[
                F.round(ratio(F.col(f"found{k}"), F.coalesce("judged", F.lit(0))), 3).alias(f"recall{k}")
                for k in (5, 10)
            ],
            F.round("mrr", 3).alias("mrr"),
            F.round(ratio(_gain(F.col("grades")), idcg), 3).alias("ndcg"),
            F.round(
                ratio(_gain(F.col("grades")), _gain(F.coalesce("best", F.array().cast("array<int>")))), 3
            ).alias("ndcg_true"),
        )
    )


def complete_metrics(metrics: DataFrame, queries: DataFrame, arm_names: list[str]) -> DataFrame:
    """A row for every query and arm; an arm without results scores zero."""
    wanted = queries.select("query_id", F.explode(F.array(*[F.lit(a) for a in arm_names])).alias("arm"))
    return wanted.join(metrics, ["arm", "query_id"], "left").na.fill(0)


def first_queries(queries: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` labelled queries, for a short online run."""
    if not 1 <= n <= 50:
        raise ValueError("n must lie between 1 and 50")
    return queries.orderBy("query_id").limit(n)


MEASURES = ("hit1", "hit3", "hit5", "recall5", "recall10", "mrr", "ndcg")


def arm_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 3).alias(m) for m in MEASURES if m in metrics.columns]
    )


def type_summary(metrics: DataFrame, queries: DataFrame) -> DataFrame:
    """Means per query type and arm, joined by query id."""
    return metrics.join(queries.select("query_id", "type"), "query_id").groupBy("type", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("hit5"), 3).alias("hit5"), F.round(F.avg("mrr"), 3).alias("mrr")
    )


def latency_percentiles(latencies: DataFrame, groups: list[str], value: str) -> DataFrame:
    return nearest_rank(latencies, groups, value, {"p50": 0.5, "p95": 0.95})


def best_arm(summary: DataFrame, names: tuple[str, ...] = HYBRID_ARMS) -> DataFrame:
    """The arm with the highest NDCG, the earlier one on a tie."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("arm"))
    return summary.where(F.col("arm").isin(*names)).agg(
        F.max_by("arm", F.struct("ndcg", -place)).alias("best_arm")
    )


def quality_gates(
    summary: DataFrame, by_type: DataFrame, gates: dict[str, float] = GATES,
    type_gates: dict[str, float] = TYPE_GATES, names: tuple[str, ...] = HYBRID_ARMS,
    type_arm: str = "hybrid_rerank",
) -> DataFrame:
    """One row per gate: value, threshold and outcome."""
    best = summary.where(F.col("arm").isin(*names)).agg(*[F.max(m).alias(m) for m in gates])
    rows = best.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("gate"), F.col(m).alias("value"), F.lit(t).alias("threshold"))
                    for m, t in gates.items()
                ]
            )
        ).alias("g")
    ).select("g.*")
    limits = F.create_map(*[F.lit(x) for kv in type_gates.items() for x in kv])
    typed = by_type.where((F.col("arm") == type_arm) & F.col("type").isin(*type_gates)).select(
        F.concat(F.col("type"), F.lit("_hit5")).alias("gate"), F.col("hit5").alias("value"), limits[F.col("type")].alias("threshold")
    )
    return rows.unionByName(typed).withColumn("passed", F.col("value") >= F.col("threshold"))


def failure_buckets(metrics: DataFrame, source_reach: DataFrame) -> DataFrame:
    """Cause of failure per query, or the arms that still fail.

    ``source_reach(query_id, any_hit, top10_hit)`` says whether any source
    found a relevant item at all and within its first ten.
    """
    hit = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("hit5")))
    wide = metrics.groupBy("query_id").agg(
        *[hit(a).alias(a) for a in ("dense", "lexical", "hybrid", "hybrid_boost", "hybrid_rerank")],
        F.max("hit5").alias("best"),
    )
    cause = (
        F.when(~F.col("any_hit"), "NO_RECALL")
        .when((F.col("hybrid") == 0) & F.col("top10_hit"), "BAD_FUSION")
        .when((F.col("hybrid") == 1) & (F.col("hybrid_rerank") == 0), "BAD_RERANK")
        .when((F.col("hybrid") == 1) & (F.col("hybrid_boost") == 0), "BOOST_HURT")
        .when(F.col("dense") == 0, "LOW_DENSE_RANK")
        .otherwise("LOW_LEXICAL_RANK")
    )
    checked = ("dense", "lexical", "hybrid", "hybrid_rerank")
    failing = F.array_compact(F.array(*[F.when(F.col(a) == 0, F.lit(a)) for a in checked]))
    return (
        wide.join(source_reach, "query_id", "left")
        .na.fill(False, ["any_hit", "top10_hit"])
        .select(
            "query_id",
            F.when(F.col("best") == 0, cause)
            .when(F.size(failing) == 0, "OK")
            .otherwise(F.concat(F.lit("PARTIAL:"), F.array_join(failing, ",")))
            .alias("bucket"),
            cause.alias("cause"),
        )
    )


def source_reach(lists: DataFrame, judgments: DataFrame) -> DataFrame:
    """Whether the raw lists ``query_id, source, rank, section_id`` hold a relevant item."""
    g = graded(lists, judgments, ("source", "query_id"))
    rel = F.col("grade") >= RELEVANT
    return g.groupBy("query_id").agg(
        F.max(rel).alias("any_hit"), F.max(rel & (F.col("rank") <= 10)).alias("top10_hit")
    )


def compare_arms(metrics: DataFrame, left: str, right: str, measures: tuple[str, ...] = ("hit5", "mrr", "ndcg")) -> DataFrame:
    """Per query, both arms side by side with their difference."""
    pick = lambda arm, m: F.max(F.when(F.col("arm") == arm, F.col(m)))
    wide = metrics.where(F.col("arm").isin(left, right)).groupBy("query_id").agg(
        *[pick(left, m).alias(f"{m}_a") for m in measures], *[pick(right, m).alias(f"{m}_b") for m in measures]
    )
    return wide.select("*", *[F.round(F.col(f"{m}_b") - F.col(f"{m}_a"), 3).alias(f"{m}_diff") for m in measures])


def no_regression(summary: DataFrame, left: str, right: str, slack: float = 0.05) -> DataFrame:
    """Right keeps the hits of left and loses at most ``slack`` in MRR."""
    pick = lambda arm, m: F.max(F.when(F.col("arm") == arm, F.col(m)))
    return summary.agg(
        (
            (pick(right, "hit5") >= pick(left, "hit5")) & (pick(right, "mrr") >= pick(left, "mrr") - slack)
        ).alias("passed")
    )


# --- other kinds of truth -----------------------------------------------------------------


def distinct_document_metrics(results: DataFrame, targets: DataFrame, documents: DataFrame) -> DataFrame:
    """Binary relevance by document: hits, MRR and NDCG over distinct documents.

    ``results(query_id, rank, document_id)``, ``targets(query_id, targets)``;
    a document is relevant when its id contains a target.  The ideal ranking
    comes from the number of relevant documents in the catalog.
    """
    ids = documents.select(F.col("id").alias("chunk_id"), F.col("id").alias("plain_text")).distinct()
    wanted = targets.select("query_id", F.col("targets").alias("keywords"))
    relevant = keyword_truth(wanted, ids).withColumnRenamed("chunk_id", "document_id")
    return document_metrics(results, relevant, targets.select("query_id"))


def document_metrics(results: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """The same with the relevant documents ``query_id, document_id`` given."""
    top = results.where(F.col("rank") <= 10)
    flagged = top.join(relevant.withColumn("rel", F.lit(True)), ["query_id", "document_id"], "left").withColumn(
        "rel", F.coalesce("rel", F.lit(False))
    )
    firsts = flagged.groupBy("query_id").agg(F.min(F.when(F.col("rel"), F.col("rank"))).alias("first_hit"))
    unique = flagged.groupBy("query_id", "document_id").agg(F.min("rank").alias("rank"), F.max("rel").alias("rel"))
    ordered = unique.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "rel"))), lambda x: x["rel"]).alias("rels")
    )
    dcg = F.aggregate(
        F.transform("rels", lambda r, i: F.when(r, 1.0 / F.log2(i + F.lit(2.0))).otherwise(0.0)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    known = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least("n_rel", F.lit(10)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + 1.0 / F.log2(i + F.lit(1.0)),
    )
    return (
        queries.select("query_id")
        .join(firsts, "query_id", "left")
        .join(ordered, "query_id", "left")
        .join(known, "query_id", "left")
        .select(
            "query_id",
            *[F.coalesce((F.col("first_hit") <= k).cast("int"), F.lit(0)).alias(f"hit{k}") for k in (1, 3, 5)],
            F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
            F.when(F.coalesce("n_rel", F.lit(0)) > 0, F.coalesce(dcg, F.lit(0.0)) / ideal)
            .otherwise(F.lit(0.0))
            .alias("ndcg"),
        )
    )


def keyword_truth(queries: DataFrame, texts: DataFrame, index: GramIndex | None = None) -> DataFrame:
    """Chunks that hold a keyword of the query, ``query_id, chunk_id``.

    ``queries(query_id, keywords)`` against ``texts(chunk_id, plain_text)``, matched exactly through a trigram index of
    the texts, which is made here if none is given.  A keyword of many queries is looked up once.
    """
    keys = queries.select("query_id", F.explode("keywords").alias("keyword")).where(F.col("keyword") != "").distinct()
    if index is None:
        made = gram_index(
            texts.select(F.col("chunk_id").alias("id"), F.lit("").alias("heading_path"), F.col("plain_text").alias("raw_markdown"))
        )
        index = GramIndex(staged(made.grams, "grams"), made.texts, made.lengths)
    if index.grams is None:
        asked = keys.withColumnRenamed("keyword", "phrase")
        if scanning.small_batch(asked):
            return scanning.distinct_holders(asked, texts)
        index = index.with_grams()
    once = keys.select("keyword").distinct()
    held = substring_truth(once, index, texts, "keyword", "keyword").withColumnRenamed("query_id", "keyword")
    return keys.join(held, "keyword").select("query_id", "chunk_id").distinct()


def truth_metrics(results: DataFrame, truth: DataFrame, k: int = 5, cutoff: int = 10) -> DataFrame:
    """Hit@k and MRR of ``arm, query_id, rank, chunk_id`` against a truth set."""
    flagged = results.where(F.col("rank") <= cutoff).join(
        truth.withColumn("rel", F.lit(True)), ["query_id", "chunk_id"], "left"
    )
    return flagged.groupBy("arm", "query_id").agg(
        F.max(F.when(F.col("rel") & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hit{k}"),
        F.coalesce(1.0 / F.min(F.when(F.col("rel"), F.col("rank"))), F.lit(0.0)).alias("mrr"),
    )


def with_fallback(first: DataFrame, second: DataFrame, truth: DataFrame) -> DataFrame:
    """Hits of the first list, or of the second where the first found no truth."""
    good = first.join(truth, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct()
    primary = first.join(good, "query_id", "left_semi").withColumn("mode", F.lit("terms"))
    backup = second.join(good, "query_id", "left_anti").withColumn("mode", F.lit("trigram"))
    return primary.unionByName(backup)
