"""Evidence packs and the validation of claims against them.

Tables: ``refs(task_id, position, chunk_id, content_hash, ...)`` asks for
evidence, ``evidence(task_id, evidence_id, chunk_id, content_hash, ...)`` is
the pack, ``results(task_id, ..., claims, tensions)`` is what came back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomtext.functions.exprs import clip, strip
from fathomtext.functions.skew import lookup_join
from fathomtext.functions.stats import numbered, top_rows
from fathomtext.functions.text import slug

# Sizes, states and thresholds.
MAX_EVIDENCE = 20
EXCERPT_CHARS = 1200
FACTUAL_STATES = ("supported", "inference", "hypothesis", "contradicted")
STATES = (*FACTUAL_STATES, "uncertain")
TASK_TYPES = ("summary", "comparison", "causal_synthesis", "tension_extraction")
MIN_COVERAGE = 0.95
MAX_UNSUPPORTED = 0.05
SECOND_PREFIX = "cog"
TASK_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,79}$"
SHA256 = r"^[0-9a-f]{64}$"
PARTIAL_SCHEMA = (
    "claims array<struct<id:string,text:string,epistemic_state:string,"
    "evidence_refs:array<string>,rationale:string>>, "
    "tensions array<struct<id:string,text:string,evidence_refs:array<string>>>, "
    "uncertainties array<string>, open_questions array<string>, summary string"
)


# --- evidence ---------------------------------------------------------------------------


def resolve_refs(refs: DataFrame, chunks: DataFrame, second: DataFrame | None = None, prefix: str = SECOND_PREFIX) -> DataFrame:
    """Each reference with the catalog's text and ``state``: ok, stale, missing.

    Ids that start with the prefix are looked up in the second corpus.
    """
    cols = ["id", "document_id", "section_id", "heading_path", "content_hash", "plain_text", "start_line", "end_line"]
    known = chunks.select(*cols).withColumn("second", F.lit(False))
    if second is not None:
        known = known.unionByName(second.select(*cols).withColumn("second", F.lit(True)))
    renamed = known.select(
        F.col("id").alias("chunk_id"), "second",
        *[F.col(c).alias(f"c_{c}") for c in cols if c != "id"],
    )
    routed = refs.withColumn("second", F.startswith("chunk_id", F.lit(f"{prefix}:")))
    joined = lookup_join(routed, renamed, ["chunk_id", "second"], "task_id", "left")
    stale = (F.col("content_hash") != F.col("c_content_hash")) & (F.col("content_hash") != "") & (F.col("c_content_hash") != "")
    return joined.withColumn(
        "state",
        F.when(F.col("c_document_id").isNull(), "missing").when(F.coalesce(stale, F.lit(False)), "stale").otherwise("ok"),
    ).drop("second")


def labelled_excerpts(resolved: DataFrame, max_evidence: int = MAX_EVIDENCE, chars: int = EXCERPT_CHARS) -> DataFrame:
    """First references of a task, labelled E1, E2, … with a cut excerpt."""
    first = top_rows(resolved, ["task_id"], [F.asc("position"), F.asc("chunk_id")], max_evidence, "at")
    return first.select(
        "task_id", F.concat(F.lit("E"), F.col("at").cast("string")).alias("ref_id"), "chunk_id", "state",
        clip(F.col("c_plain_text"), chars).alias("excerpt"),
    )


def pack_evidence(resolved: DataFrame, chars: int = EXCERPT_CHARS, max_evidence: int = MAX_EVIDENCE) -> DataFrame:
    """Rows of an evidence pack, numbered EV001, EV002, …

    A task with more than ``max_evidence`` references is refused whole, so a pack holds every
    reference of its task or has no rows; the limit also bounds the rank.
    """
    counts = resolved.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    admitted = resolved.join(counts.where(F.col("n") <= max_evidence).select("task_id"), "task_id", "left_semi")
    first = top_rows(admitted, ["task_id"], [F.asc("position"), F.asc("chunk_id")], max_evidence, "at")
    heading = F.coalesce(F.nullif("c_heading_path", F.lit("")), F.lit(""))
    return first.select(
        "task_id",
        F.format_string("EV%03d", "at").alias("evidence_id"),
        F.coalesce("c_document_id", F.lit("")).alias("document_id"),
        F.col("c_section_id").alias("section_id"),
        "chunk_id",
        F.coalesce("c_content_hash", "content_hash").alias("content_hash"),
        F.coalesce(F.nullif(heading, F.lit("")), "c_document_id").alias("title"),
        F.filter(F.split(heading, r"(?U)\s*>\s*"), lambda p: p != "").alias("heading_path"),
        F.col("c_start_line").alias("start_line"),
        F.col("c_end_line").alias("end_line"),
        clip(F.col("c_plain_text"), chars).alias("excerpt"),
        "state",
    )


def pack_admission(tasks: DataFrame, refs: DataFrame, max_evidence: int = MAX_EVIDENCE) -> DataFrame:
    """Tasks with ``reason``: null when admitted."""
    counts = refs.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_refs"))
    return (
        tasks.join(counts, "task_id", "left")
        .na.fill(0, ["n_refs"])
        .withColumn(
            "reason",
            F.when(strip(F.coalesce("query", F.lit(""))) == "", "empty_query")
            .when(F.col("n_refs") == 0, "no_evidence")
            .when(F.col("n_refs") > max_evidence, "too_much_evidence"),
        )
    )


def task_ids(tasks: DataFrame, seq: str = "seq", created: str = "created_at", query: str = "query") -> DataFrame:
    """Add ``task_id``: time and slug of the query, ``-2``, ``-3`` on a collision."""
    base = F.concat(F.date_format(created, "yyyyMMdd_HHmmss"), F.lit("_"), slug(F.col(query)))
    at = numbered(tasks.withColumn("_base", base), ["_base"], seq, "_k")
    return at.withColumn(
        "task_id", F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", "_k"))
    ).drop("_base", "_k")


def new_tasks_only(tasks: DataFrame, existing: DataFrame) -> DataFrame:
    return tasks.join(existing.select("task_id"), "task_id", "left_anti")


def manifest(files: DataFrame, evidence: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Per task: hash of every input file and row counts.

    ``files(task_id, name, content)`` holds the few named inputs of a pack.
    """
    hashes = files.groupBy("task_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_set(F.struct("name", F.sha2("content", 256).alias("sha"))))
        ).alias("files")
    )
    count = lambda df, name: df.groupBy("task_id").agg(F.count(F.lit(1)).alias(name))
    out = hashes.join(count(evidence, "evidence_count"), "task_id", "left")
    if context is None:
        out = out.withColumn("context_count", F.lit(0).cast("long"))
    else:
        out = out.join(count(context, "context_count"), "task_id", "left")
    return out.na.fill(0, ["evidence_count", "context_count"])


def partial_result(raw: Column) -> Column:
    """Only the generated fields of a raw result."""
    return F.from_json(raw, PARTIAL_SCHEMA)


# --- claims -----------------------------------------------------------------------------


def claim_rows(results: DataFrame) -> DataFrame:
    return results.select("task_id", F.posexplode("claims").alias("pos", "c")).select(
        "task_id", "pos", F.col("c.id").alias("claim_id"), F.col("c.text").alias("text"),
        F.col("c.epistemic_state").alias("epistemic_state"), F.col("c.evidence_refs").alias("refs"),
    )


def validate_drafts(
    results: DataFrame, evidence: DataFrame, claims: DataFrame | None = None, tension_refs: DataFrame | None = None
) -> DataFrame:
    """Per task: repeated claim ids, foreign references, coverage, unsupported rate.

    ``claims(task_id, pos, claim_id, epistemic_state, refs)`` may be given flat;
    otherwise it is exploded from the nested results.
    """
    if claims is None:
        claims = claim_rows(results)
        tension_refs = results.select("task_id", F.explode("tensions").alias("t")).select(
            "task_id", F.explode("t.evidence_refs").alias("chunk_id")
        )
    provided = evidence.select("task_id", "chunk_id").distinct().withColumn("provided", F.lit(True))
    cited = claims.select("task_id", "pos", "epistemic_state", F.explode_outer("refs").alias("chunk_id"))
    checked = cited.join(provided, ["task_id", "chunk_id"], "left").withColumn(
        "provided", F.coalesce("provided", F.lit(False))
    )
    per_claim = checked.groupBy("task_id", "pos", "epistemic_state").agg(
        F.max("provided").alias("supported"),
        F.count_if(F.col("chunk_id").isNotNull() & ~F.col("provided")).alias("foreign_refs"),
    )
    factual = F.col("epistemic_state").isin(*FACTUAL_STATES)
    per_task = per_claim.groupBy("task_id").agg(
        F.count_if(factual).alias("factual_claims"),
        F.count_if(factual & F.col("supported")).alias("cited_claims"),
        F.sum("foreign_refs").alias("foreign_refs"),
    )
    repeated = (
        claims.groupBy("task_id", "claim_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("task_id").agg(F.count_if(F.col("n") > 1).alias("duplicate_claim_ids"))
    )
    out = results.select("task_id").distinct().join(per_task, "task_id", "left").join(repeated, "task_id", "left")
    if tension_refs is not None:
        foreign = tension_refs.join(provided, ["task_id", "chunk_id"], "left_anti").groupBy("task_id").agg(
            F.count(F.lit(1)).alias("tension_foreign")
        )
        out = out.join(foreign, "task_id", "left")
    else:
        out = out.withColumn("tension_foreign", F.lit(0).cast("long"))
    out = out.na.fill(0)
    n = F.col("factual_claims")
    return out.select(
        "task_id",
        "factual_claims",
        "cited_claims",
        (n - F.col("cited_claims")).alias("unsupported_claims"),
        (F.col("foreign_refs") + F.col("tension_foreign")).alias("citation_invalid"),
        "duplicate_claim_ids",
        F.when(n > 0, F.col("cited_claims") / n).alias("citation_coverage"),
        F.when(n > 0, (n - F.col("cited_claims")) / n).alias("unsupported_claim_rate"),
        (F.col("duplicate_claim_ids") == 0).alias("schema_valid"),
    )


def automatic_gate(reports: DataFrame) -> DataFrame:
    """Add ``passed``: enough coverage, few unsupported claims, nothing invalid."""
    return reports.withColumn(
        "passed",
        F.coalesce(F.col("citation_coverage") >= MIN_COVERAGE, F.lit(False))
        & F.coalesce(F.col("unsupported_claim_rate") <= MAX_UNSUPPORTED, F.lit(False))
        & (F.col("citation_invalid") == 0)
        & F.col("schema_valid")
        & (F.col("factual_claims") > 0),
    )


def claim_pairs(claims: DataFrame, chars: int = 160) -> DataFrame:
    """Claim and evidence side by side for review; uncertain claims stay out."""
    return claims.where(~F.col("epistemic_state").eqNullSafe("uncertain")).select(
        "task_id", "claim_id", clip(F.coalesce("text", F.lit("")), chars).alias("claim_text"),
        "epistemic_state", F.explode("refs").alias("chunk_id"),
    )
