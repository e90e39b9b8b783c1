"""Import gates of task packs, their order, and the views on packs and runs.

Gates are rows ``task_id, step, name, passed, failure``: steps run in order and
a task stops at its first failing step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomtext.operators.grounding import (
    MAX_UNSUPPORTED,
    MIN_COVERAGE,
    SHA256,
    STATES,
    TASK_ID,
    TASK_TYPES,
    resolve_refs,
)

# Order of the steps and the files a returned pack must hold.
STEPS = ("manifest", "result_schema", "task_id", "prompt_sha", "evidence_membership", "citation", "stale")
RESULT_FILES = ("result/result.json", "result/run_meta.json", "result/DONE")


def safe_task_id(c: Column) -> Column:
    return F.coalesce(c.rlike(TASK_ID) & ~F.contains(c, F.lit("..")), F.lit(False))


def _row(step: str, passed: Column, failure: Column | None = None, name: str | None = None) -> list[Column]:
    ok = F.coalesce(passed, F.lit(False))
    note = F.lit(None).cast("string") if failure is None else failure.cast("string")
    return [
        F.col("task_id"),
        F.lit(STEPS.index(step) + 1).alias("step"),
        F.lit(name or step).alias("name"),
        ok.alias("passed"),
        F.when(~ok, F.coalesce(note, F.lit(name or step))).alias("failure"),
    ]


def manifest_gate(tasks: DataFrame, manifests: DataFrame, files: DataFrame, counts: DataFrame) -> DataFrame:
    """Every listed file present with its hash, and both row counts equal.

    ``manifests(task_id, files, evidence_count, context_count)``,
    ``files(task_id, name, sha256)``, ``counts(task_id, evidence_rows, context_rows)``.
    """
    listed = manifests.select("task_id", F.explode("files").alias("name", "expected"))
    bad = (
        listed.join(files.select("task_id", "name", "sha256"), ["task_id", "name"], "left")
        .where(~F.col("expected").eqNullSafe(F.col("sha256")))
        .groupBy("task_id")
        .agg(F.min("name").alias("bad_file"))
    )
    m = manifests.select("task_id", "evidence_count", "context_count", F.lit(True).alias("present"))
    j = tasks.select("task_id").join(m, "task_id", "left").join(bad, "task_id", "left").join(counts, "task_id", "left")
    rows_equal = (F.col("evidence_count") == F.coalesce("evidence_rows", F.lit(0))) & (
        F.col("context_count") == F.coalesce("context_rows", F.lit(0))
    )
    failure = (
        F.when(F.col("present").isNull(), "manifest missing")
        .when(F.col("bad_file").isNotNull(), F.concat(F.lit("file differs: "), F.col("bad_file")))
        .otherwise("row counts differ")
    )
    return j.select(*_row("manifest", F.col("present").isNotNull() & F.col("bad_file").isNull() & rows_equal, failure))


def valid_result(r: str = "") -> Column:
    """Required fields, enumerations and id shape of a result row."""
    c = lambda name: F.col(f"{r}{name}")
    filled = lambda x: F.coalesce(F.length(x) > 0, F.lit(False))
    claims_ok = F.forall(
        F.coalesce(c("claims"), F.array()),
        lambda x: x["id"].isNotNull() & (F.length(x["text"]) > 0) & x["epistemic_state"].isin(*STATES),
    )
    tensions_ok = F.forall(
        F.coalesce(c("tensions"), F.array()), lambda x: x["id"].isNotNull() & (F.length(x["text"]) > 0)
    )
    needed_ok = F.forall(
        F.coalesce(c("additional_evidence_needed"), F.array()),
        lambda x: (F.length(x["question"]) > 0) & (F.length(x["reason"]) > 0),
    )
    return (
        F.coalesce(c("schema_version"), F.lit("1.0")).eqNullSafe("1.0")
        & safe_task_id(c("task_id"))
        & F.coalesce(c("task_type").isin(*TASK_TYPES), F.lit(False))
        & filled(c("query"))
        & filled(c("worker")["tool"])
        & filled(c("generated_at"))
        & F.coalesce(claims_ok, F.lit(False))
        & F.coalesce(tensions_ok, F.lit(False))
        & F.coalesce(needed_ok, F.lit(False))
    )


def valid_iso_time(c: Column) -> Column:
    return F.try_to_timestamp(c).isNotNull()


def valid_manifest() -> Column:
    return (
        safe_task_id(F.col("task_id"))
        & F.coalesce(valid_iso_time(F.col("created_at")), F.lit(False))
        & F.coalesce(F.forall(F.map_values("files"), lambda h: F.lower(F.trim(h)).rlike(SHA256)), F.lit(True))
        & (F.coalesce("evidence_count", F.lit(0)) >= 0)
        & (F.coalesce("context_count", F.lit(0)) >= 0)
    )


def schema_gate(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` carries ``pack_id`` (the pack it lies in) and the result fields."""
    ok = results.select(F.col("pack_id"), valid_result().alias("ok"))
    j = tasks.select("task_id").join(ok.withColumnRenamed("pack_id", "task_id"), "task_id", "left")
    return j.select(*_row("result_schema", F.col("ok"), F.lit("result missing or invalid")))


def task_id_gate(tasks: DataFrame, results: DataFrame) -> DataFrame:
    r = results.select(F.col("pack_id").alias("task_id"), F.col("task_id").alias("claimed"))
    j = tasks.select("task_id").join(r, "task_id", "left")
    return j.select(*_row("task_id", F.col("claimed") == F.col("task_id"), F.lit("task id differs")))


def prompt_gate(tasks: DataFrame, run_meta: DataFrame, files: DataFrame, prompt: str = "AGENT_INSTRUCTION.md", manifest_name: str = "manifest.json") -> DataFrame:
    """The hashes the worker saw equal those of the prompt and the manifest.

    ``run_meta`` carries ``pack_id``, the pack it lies in.
    """
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("sha256")))
    hashes = files.where(F.col("name").isin(prompt, manifest_name)).groupBy("task_id").agg(
        pick(prompt).alias("prompt_hash"), pick(manifest_name).alias("manifest_hash")
    )
    j = tasks.select("task_id").join(
        run_meta.select(F.col("pack_id").alias("task_id"), "prompt_sha256", "task_manifest_sha256"), "task_id", "left"
    ).join(hashes, "task_id", "left")
    same = (F.lower("prompt_sha256") == F.col("prompt_hash")) & (
        F.lower("task_manifest_sha256") == F.col("manifest_hash")
    )
    return j.select(*_row("prompt_sha", same, F.lit("prompt or manifest hash differs")))


def membership_gate(tasks: DataFrame, reference_rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every cited chunk is part of the pack: ``reference_rows(task_id, chunk_id)``."""
    foreign = reference_rows.join(evidence.select("task_id", "chunk_id"), ["task_id", "chunk_id"], "left_anti")
    bad = foreign.groupBy("task_id").agg(F.min("chunk_id").alias("bad_ref"))
    j = tasks.select("task_id").join(bad, "task_id", "left")
    return j.select(*_row("evidence_membership", F.col("bad_ref").isNull(), F.concat(F.lit("not in the pack: "), F.col("bad_ref"))))


def citation_gate(tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """Three rows per task, or one when its claims are malformed."""
    j = tasks.select("task_id").join(reports, "task_id", "left")
    coverage_ok = F.col("citation_coverage") >= MIN_COVERAGE
    unsupported_ok = F.col("unsupported_claim_rate") <= MAX_UNSUPPORTED
    well_formed = j.where(F.coalesce("schema_valid", F.lit(False)))
    malformed = j.where(~F.coalesce("schema_valid", F.lit(False)))
    return (
        malformed.select(*_row("citation", F.lit(False), F.lit("claims malformed"), "citation_coverage"))
        .unionByName(
            well_formed.select(*_row("citation", F.col("citation_invalid") == 0, F.lit("foreign references"), "citation_invalid"))
        )
        .unionByName(well_formed.select(*_row("citation", coverage_ok, F.lit("coverage too low"), "citation_coverage")))
        .unionByName(well_formed.select(*_row("citation", unsupported_ok, F.lit("too many unsupported"), "unsupported_claim")))
    )


def stale_gate(tasks: DataFrame, evidence: DataFrame, chunks: DataFrame, second: DataFrame | None = None, blocking: bool = True) -> DataFrame:
    """Evidence whose text changed or vanished since the pack was made."""
    refs = evidence.select("task_id", F.lit(0).alias("position"), "chunk_id", "content_hash")
    bad = (
        resolve_refs(refs, chunks, second)
        .where(F.col("state") != "ok")
        .groupBy("task_id")
        .agg(F.min("chunk_id").alias("bad_chunk"))
    )
    j = tasks.select("task_id").join(bad, "task_id", "left")
    passed = F.col("bad_chunk").isNull() | F.lit(not blocking)
    return j.select(*_row("stale", passed, F.concat(F.lit("changed since: "), F.col("bad_chunk"))))


def _place() -> Column:
    """Order of the rows inside a step."""
    names = F.array(*[F.lit(n) for n in ("citation_invalid", "citation_coverage", "unsupported_claim")])
    return F.array_position(names, F.col("name"))


def in_order(gates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gate rows that were reached, and one report per task.

    A task stops after the step that fails; within that step the last failing
    gate is reported and the first is named.
    """
    stop = gates.groupBy("task_id").agg(
        F.min(F.when(~F.col("passed"), F.col("step"))).alias("stop")
    )
    reached = gates.join(stop, "task_id").where(F.col("stop").isNull() | (F.col("step") <= F.col("stop"))).drop("stop")
    reports = reached.groupBy("task_id").agg(
        F.min("passed").alias("passed"),
        F.min_by("name", F.when(~F.col("passed"), F.struct("step", _place()))).alias("first_failure"),
        F.min_by("failure", F.when(~F.col("passed"), F.struct("step", _place()))).alias("reason"),
        F.coalesce(F.max(~F.col("passed") & (F.col("name") == "stale")), F.lit(False)).alias("stale"),
        F.count(F.lit(1)).alias("gates_run"),
    )
    return reached, reports


# --- views ------------------------------------------------------------------------------


def pack_status(listing: DataFrame) -> DataFrame:
    """Status from the directory and marker files: ``listing(task_id, place, name)``."""
    has = lambda n: F.max(F.col("name") == n)
    flags = listing.groupBy("task_id", "place").agg(
        has("result/INVALID").alias("invalid"), has("result/IMPORTED").alias("imported"),
        has("result/DONE").alias("done"), has("result/FAILED").alias("failed"),
    )
    return flags.select(
        "task_id",
        "place",
        F.when(F.col("place") == "outbox", "READY")
        .when(F.col("place") == "processing", "PROCESSING")
        .when(F.col("place") == "failed", F.when(F.col("failed"), "FAILED").otherwise("PROCESSING"))
        .when(F.col("place") == "archive", "ARCHIVED")
        .when(
            F.col("place") == "completed",
            F.when(F.col("invalid"), "INVALID_RESULT")
            .when(F.col("imported"), "IMPORTED")
            .when(F.col("done"), "COMPLETED")
            .otherwise("PROCESSING"),
        )
        .otherwise("READY")
        .alias("status"),
    )


def ready_for_import(status: DataFrame) -> DataFrame:
    return status.where(F.col("status") == "COMPLETED").select("task_id")


def task_list(status: DataFrame, tasks: DataFrame, manifests: DataFrame, results: DataFrame, run_meta: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per pack with what is known about it."""
    t = tasks.select("task_id", "task_type", "query", F.col("created_at").alias("t_created"))
    m = manifests.select("task_id", "evidence_count", F.col("created_at").alias("m_created"))
    r = results.select(
        F.col("pack_id").alias("task_id"), F.col("worker.tool").alias("r_tool"), F.col("worker.model").alias("r_model"),
        F.col("generated_at").alias("completed_at"),
    )
    meta = run_meta.select("task_id", "worker_tool", F.col("model").alias("m_model"))
    e = reports.select("task_id", "stale", F.when(~F.col("passed"), F.col("reason")).alias("error"))
    out = status
    for part in (t, m, r, meta, e):
        out = out.join(part, "task_id", "left")
    return out.select(
        "task_id", "place", "status", "task_type", "query", F.coalesce("t_created", "m_created").alias("created_at"),
        "evidence_count", F.coalesce("worker_tool", "r_tool").alias("worker"),
        F.when(F.col("worker_tool").isNotNull(), F.col("m_model")).otherwise(F.col("r_model")).alias("model"),
        "completed_at", F.coalesce("stale", F.lit(False)).alias("stale"), "error",
    )


def run_catalog(tasks: DataFrame) -> DataFrame:
    """Runs with their number of tasks: ``tasks(run_id, task_id)``."""
    return tasks.groupBy("run_id").agg(F.countDistinct("task_id").alias("tasks")).orderBy("run_id")


def task_summaries(results: DataFrame) -> DataFrame:
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    return results.select(
        F.col("pack_id").alias("task_id"), "task_type", "query", "summary",
        size("claims").alias("claims"), size("tensions").alias("tensions"),
        size("uncertainties").alias("uncertainties"), size("open_questions").alias("open_questions"),
    )


def task_set_problems(expected: DataFrame, files: DataFrame, required: tuple[str, ...] = RESULT_FILES) -> DataFrame:
    """Missing, unexpected and unsafe tasks, and missing required files.

    ``expected(task_id)``, ``files(task_id, name)``; empty when complete.
    """
    actual = files.groupBy("task_id").agg(
        *[F.max(F.col("name") == n).alias(f"f{i}") for i, n in enumerate(required)]
    ).withColumn("actual", F.lit(True))
    j = expected.select("task_id").distinct().withColumn("expected", F.lit(True)).join(actual, "task_id", "full_outer")
    missing = F.array_compact(
        F.array(*[F.when(~F.coalesce(f"f{i}", F.lit(False)), F.lit(n)) for i, n in enumerate(required)])
    )
    problem = (
        F.when(F.col("actual").isNull(), "missing_task")
        .when(F.col("expected").isNull(), "unexpected_task")
        .when(~safe_task_id(F.col("task_id")), "unsafe_id")
        .when(F.size(missing) > 0, F.concat(F.lit("missing_file:"), F.array_join(missing, ",")))
    )
    return j.select("task_id", problem.alias("problem")).where("problem IS NOT NULL")


def run_rollup(reached: DataFrame, reports: DataFrame, drafts: DataFrame) -> DataFrame:
    """How many tasks of a run pass each gate, one row."""
    by_gate = reached.agg(
        F.count_if((F.col("name") == "manifest") & F.col("passed")).alias("manifest_ok")
    )
    by_draft = drafts.agg(
        F.count_if("schema_valid").alias("schema_ok"),
        F.sum("citation_invalid").alias("citation_invalid"),
        F.count_if(F.col("citation_coverage") >= MIN_COVERAGE).alias("coverage_ok"),
        F.count_if(F.col("unsupported_claim_rate") <= MAX_UNSUPPORTED).alias("unsupported_ok"),
    )
    total = reports.agg(F.count(F.lit(1)).alias("tasks"), F.count_if("passed").alias("passed"))
    return total.select(
        "tasks", "passed",
        by_gate.select("manifest_ok").scalar().alias("manifest_ok"),
        *[by_draft.select(c).scalar().alias(c) for c in ("schema_ok", "citation_invalid", "coverage_ok", "unsupported_ok")],
    )


def pack_consistency(tasks: DataFrame, manifests: DataFrame, evidence: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Packs whose manifest disagrees with the task or the row counts.

    ``manifests`` carries ``pack_id`` beside its own ``task_id``.
    """
    n = lambda df, name: df.groupBy("task_id").agg(F.count(F.lit(1)).alias(name))
    j = tasks.select("task_id").join(
        manifests.select(
            F.col("pack_id").alias("task_id"), F.col("task_id").alias("m_task"), "evidence_count", "context_count"
        ),
        "task_id",
        "left",
    ).join(n(evidence, "n_ev"), "task_id", "left")
    j = j.join(n(context, "n_ctx"), "task_id", "left") if context is not None else j.withColumn("n_ctx", F.lit(0))
    problem = (
        F.when(~F.col("m_task").eqNullSafe(F.col("task_id")), "task_id")
        .when(~F.col("evidence_count").eqNullSafe(F.coalesce("n_ev", F.lit(0))), "evidence_count")
        .when(~F.col("context_count").eqNullSafe(F.coalesce("n_ctx", F.lit(0))), "context_count")
    )
    return j.select("task_id", problem.alias("problem")).where("problem IS NOT NULL")
