"""Registered queries: evidence, claims, gates, task ids, incremental ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fathomtext.operators import gates, grounding
from fathomtext.registered import inputs
from fathomtext.sources.staging import staged
from fathomtext.streaming.ingest import stream_catalog


def _catalog(spark, sf_dir) -> DataFrame:
    """Documents as chunks of the catalog; Spanish ones belong to the second corpus."""
    d = inputs.table(spark, sf_dir, "documents")
    key = F.concat(F.when(F.col("lang") == "es", "cog:").otherwise("D"), F.col("doc_id").cast("string"))
    return d.select(
        key.alias("id"), key.alias("document_id"), F.col("source").alias("section_id"),
        F.concat_ws(" > ", "source", "lang").alias("heading_path"), F.sha2("text", 256).alias("content_hash"),
        F.col("text").alias("plain_text"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), "lang",
    )


def _refs(spark, sf_dir) -> DataFrame:
    """Labelled documents as references, grouped into tasks by source.

    Toxic ones carry an outdated hash, low-quality ones name a chunk that is gone.
    """
    d = inputs.table(spark, sf_dir, "documents").join(inputs.table(spark, sf_dir, "labels"), "doc_id")
    key = F.concat(F.when(F.col("lang") == "es", "cog:").otherwise("D"), F.col("doc_id").cast("string"))
    return d.select(
        F.concat(F.lit("task-"), F.col("source")).alias("task_id"), F.col("doc_id").alias("position"),
        F.when(F.col("quality") == 0, F.concat(key, F.lit("-gone"))).otherwise(key).alias("chunk_id"),
        F.when(F.col("toxic") == 1, F.md5("text")).otherwise(F.sha2("text", 256)).alias("content_hash"),
    )


def _resolved(spark, sf_dir) -> DataFrame:
    c = _catalog(spark, sf_dir)
    return grounding.resolve_refs(_refs(spark, sf_dir), c.where("lang <> 'es'"), c.where("lang = 'es'"))


def evidence_resolve(spark, sf_dir) -> DataFrame:
    return _resolved(spark, sf_dir).select("task_id", "chunk_id", "state", F.col("c_section_id").alias("section_id"))


def evidence_pack(spark, sf_dir) -> DataFrame:
    p = grounding.pack_evidence(_resolved(spark, sf_dir))
    return p.select(
        "task_id", "evidence_id", "chunk_id", "document_id", "title", F.array_join("heading_path", "|").alias("heading_path"),
        "end_line", F.md5("excerpt").alias("excerpt_digest"), "state",
    )


def evidence_excerpts(spark, sf_dir) -> DataFrame:
    return grounding.labelled_excerpts(_resolved(spark, sf_dir))


def pack_admission(spark, sf_dir) -> DataFrame:
    d = inputs.table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "de").alias("n_de"))
    tasks = d.select(F.concat(F.lit("task-"), F.col("source")).alias("task_id"), F.when(F.col("n_de") > 6, "  ").otherwise("q").alias("query"))
    return grounding.pack_admission(tasks, _refs(spark, sf_dir)).select("task_id", "n_refs", "reason")


def task_ids(spark, sf_dir) -> DataFrame:
    """One task per document, created at a second given by its length."""
    d = inputs.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n_chars") % 10).alias("created_at"),
        F.col("text").alias("query"),
    )
    return grounding.task_ids(d).select("seq", "task_id")


def _drafts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    evidence, claims = inputs.exchanges(spark, sf_dir)
    tasks = inputs.table(spark, sf_dir, "conversations").select(F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("task_id")).distinct()
    return tasks, evidence, claims, grounding.validate_drafts(tasks, evidence, claims)


def claim_coverage(spark, sf_dir) -> DataFrame:
    reports = grounding.automatic_gate(_drafts(spark, sf_dir)[3])
    return reports.select(
        "task_id", "factual_claims", "cited_claims", "unsupported_claims", "citation_invalid", "duplicate_claim_ids",
        F.round("citation_coverage", 6).alias("citation_coverage"), F.round("unsupported_claim_rate", 6).alias("unsupported_claim_rate"),
        "schema_valid", "passed",
    )


def _returned_packs(spark, sf_dir) -> DataFrame:
    """A result and its run record for each dialogue; the length of the first turn decides what is wrong with it."""
    c = inputs.table(spark, sf_dir, "conversations")
    sha = F.sha2("text", 256)
    one = c.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.length("text"))).alias("n0"),
        F.max(F.when(F.col("turn") == 0, sha)).alias("h0"),
        F.max(F.when(F.col("turn") == 1, sha)).alias("h1"),
    )
    pack = F.concat(F.lit("t"), F.col("conv_id").cast("string"))
    item = "array<struct<id: string, text: string, epistemic_state: string>>"
    return one.select(
        pack.alias("pack_id"),
        F.when(F.col("n0") % 7 == 0, F.concat(F.lit("x"), pack)).otherwise(pack).alias("task_id"),
        F.lit("1.0").alias("schema_version"), F.lit(grounding.TASK_TYPES[0]).alias("task_type"), F.lit("q").alias("query"),
        F.struct(F.when(F.col("n0") % 13 == 0, "").otherwise("tool").alias("tool"), F.lit("m").alias("model")).alias("worker"),
        F.lit("2026-01-01T00:00:00").alias("generated_at"),
        F.array().cast(item).alias("claims"), F.array().cast(item).alias("tensions"),
        F.array().cast("array<struct<question: string, reason: string>>").alias("additional_evidence_needed"),
        F.when(F.col("n0") % 5 == 0, F.md5("h0")).otherwise(F.upper("h0")).alias("prompt_sha256"),
        F.col("h1").alias("task_manifest_sha256"),
    )


def _hashes(spark, sf_dir) -> DataFrame:
    """The first two turns of a dialogue stand for its prompt and its manifest file."""
    c = inputs.table(spark, sf_dir, "conversations").where("turn < 2")
    return c.select(
        F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("task_id"),
        F.when(F.col("turn") == 0, "AGENT_INSTRUCTION.md").otherwise("manifest.json").alias("name"),
        F.sha2("text", 256).alias("sha256"),
    )


def _gate_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    tasks, evidence, claims, drafts = _drafts(spark, sf_dir)
    # Each gate is a job of its own: in one plan the sorts of all their joins would hold their memory in one task at once.
    tasks, drafts = staged(tasks, "tasks"), staged(drafts, "drafts")
    cited = claims.select("task_id", F.explode("refs").alias("chunk_id"))
    # The catalog knows every user turn; those of long turns have changed since.
    c = inputs.table(spark, sf_dir, "conversations").where("role = 'user'")
    chunks = c.select(
        F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"),
        F.lit("d").alias("document_id"), F.lit("s").alias("section_id"), F.lit("h").alias("heading_path"),
        F.when(F.length("text") > 900, F.md5("text")).otherwise(F.sha2("text", 256)).alias("content_hash"),
        F.col("text").alias("plain_text"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
    )
    made = _returned_packs(spark, sf_dir)
    each = [
        gates.manifest_gate(tasks, *(x.withColumn("task_id", F.concat(F.lit("t"), "task_id")) for x in _manifests(spark, sf_dir))),
        gates.schema_gate(tasks, made),
        gates.task_id_gate(tasks, made),
        gates.prompt_gate(tasks, made, _hashes(spark, sf_dir)),
        gates.membership_gate(tasks, cited, evidence),
        gates.citation_gate(tasks, drafts),
        gates.stale_gate(tasks, evidence, chunks),
    ]
    rows = reduce(DataFrame.unionByName, [staged(gate, "gate") for gate in each])
    return rows, drafts


def gate_first_failure(spark, sf_dir) -> DataFrame:
    _, reports = gates.in_order(_gate_rows(spark, sf_dir)[0])
    return reports.select("task_id", "passed", "first_failure", "stale", "gates_run")


def run_rollup(spark, sf_dir) -> DataFrame:
    rows, drafts = _gate_rows(spark, sf_dir)
    return gates.run_rollup(*gates.in_order(rows), drafts)


def claim_pairs(spark, sf_dir) -> DataFrame:
    return grounding.claim_pairs(inputs.exchanges(spark, sf_dir)[1])


def _turn_files(spark, sf_dir) -> DataFrame:
    c = inputs.table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("task_id"), F.format_string("f%03d", "turn").alias("name"), F.col("text").alias("content"), "role")


def manifest_hashes(spark, sf_dir) -> DataFrame:
    files = _turn_files(spark, sf_dir)
    m = grounding.manifest(files, files.where("role = 'user'"), files.where("role = 'assistant'"))
    return m.select(
        "task_id", F.size("files").alias("n_files"), F.element_at("files", F.lit("f000")).alias("first_hash"), "evidence_count", "context_count"
    )


def manifest_gate(spark, sf_dir) -> DataFrame:
    files = _turn_files(spark, sf_dir)
    return gates.manifest_gate(files.select("task_id").distinct(), *_manifests(spark, sf_dir)).select("task_id", "passed", "failure")


def _manifests(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifests, the files now, of which the short ones were changed, and the row counts."""
    files = _turn_files(spark, sf_dir)
    m = grounding.manifest(files, files.where("role = 'user'"), files.where("role = 'assistant'"))
    now = files.select("task_id", "name", F.when(F.length("content") < 60, F.md5("content")).otherwise(F.sha2("content", 256)).alias("sha256"))
    counts = files.groupBy("task_id").agg(
        F.count_if(F.col("role") == "user").alias("evidence_rows"), F.count_if(F.col("role") == "assistant").alias("context_rows")
    )
    return m, now, counts


def pack_status(spark, sf_dir) -> DataFrame:
    """Dialogues as packs: the place follows the length of the first turn, markers that of the others."""
    c = inputs.table(spark, sf_dir, "conversations")
    n = F.length("text")
    opening = c.where("turn = 0").select("conv_id", F.length("text").alias("n0"))
    place = F.when(F.col("n0") < 150, "outbox").when(F.col("n0") < 250, "failed").otherwise("completed")
    marker = F.when(n > 1500, "result/INVALID").when(n > 1000, "result/IMPORTED").when(n > 700, "result/DONE").when(n > 600, "result/FAILED").otherwise("task.yaml")
    listing = c.join(opening, "conv_id").select(F.col("conv_id").alias("task_id"), place.alias("place"), marker.alias("name"))
    return gates.pack_status(listing)


def task_set_check(spark, sf_dir) -> DataFrame:
    """Labelled documents are the expected tasks, all German and English ones the actual."""
    d = inputs.table(spark, sf_dir, "documents")
    labels = inputs.table(spark, sf_dir, "labels").select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("task_id"))
    have = F.array_compact(F.array(
        F.lit("result/result.json"), F.when(F.col("n_chars") > 300, "result/run_meta.json"), F.when(F.col("n_chars") > 200, "result/DONE")
    ))
    files = d.where(F.col("lang").isin("de", "en")).select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("task_id"), F.explode(have).alias("name"))
    return gates.task_set_problems(labels, files)


def incremental_ingest(spark, sf_dir) -> DataFrame:
    """Events arrive as a stream and are merged into a catalog of users."""
    return stream_catalog(spark, f"{sf_dir}/events.parquet")


QUERIES = {
    f.__name__: f
    for f in (
        evidence_resolve, evidence_pack, evidence_excerpts, pack_admission, task_ids, claim_coverage, gate_first_failure,
        run_rollup, claim_pairs, manifest_hashes, manifest_gate, pack_status, task_set_check, incremental_ingest,
    )
}
