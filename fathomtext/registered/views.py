"""Registered queries: request checks, logs, packs seen as lists, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomtext.operators import catalog, dense, gates, grounding, reconcile
from fathomtext.plans.search import valid_queries
from fathomtext.registered import inputs


def _named(doc_id: str = "doc_id") -> F.Column:
    return F.concat(F.lit("D"), F.col(doc_id).cast("string"))


def _task() -> F.Column:
    return F.concat(F.lit("t"), F.col("conv_id").cast("string"))


def rejected_queries(spark, sf_dir) -> DataFrame:
    """Every document's text as a request."""
    d = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return valid_queries(d)[1].select("query_id", "reason")


def run_catalog(spark, sf_dir) -> DataFrame:
    return gates.run_catalog(inputs.table(spark, sf_dir, "documents").select(F.col("source").alias("run_id"), F.col("lang").alias("task_id")))


def new_tasks(spark, sf_dir) -> DataFrame:
    made = inputs.table(spark, sf_dir, "documents").select(_named().alias("task_id"))
    return grounding.new_tasks_only(made, inputs.table(spark, sf_dir, "labels").select(_named().alias("task_id")))


def last_deletions(spark, sf_dir) -> DataFrame:
    """Low-quality documents were deleted before, toxic ones are deleted now; some are both."""
    d = inputs.table(spark, sf_dir, "documents").join(inputs.table(spark, sf_dir, "labels"), "doc_id")
    known = d.select(_named().alias("id"), F.sha2("text", 256).alias("sha256"))
    log = d.where("quality = 0").select(
        F.concat("source", F.lit("/"), _named()).alias("source_path"), _named().alias("document_id"),
        F.md5("text").alias("last_sha256"), F.lit("2026-01-01").alias("deleted_at"),
    )
    gone = d.where("toxic = 1").select(F.concat("source", F.lit("/"), _named()).alias("path"), _named().alias("document_id"))
    return catalog.latest_tombstones(catalog.tombstones(log, gone, known, F.lit("2026-02-01")))


def _job_log(spark, sf_dir) -> DataFrame:
    """A job for each document, finished for the labelled ones."""
    jobs = inputs.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.lit("running").alias("status"), F.col("n_chars").alias("created_at"),
        F.lit(None).cast("long").alias("finished_at"), F.lit(None).cast("string").alias("error"),
    )
    ended = inputs.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "done").otherwise("failed").alias("status"),
        (F.col("doc_id") * 10).alias("finished_at"), F.when(F.col("quality") == 0, "low quality").alias("error"),
    )
    return catalog.finish_jobs(jobs, ended)


def job_log(spark, sf_dir) -> DataFrame:
    return _job_log(spark, sf_dir)


def recent_jobs(spark, sf_dir) -> DataFrame:
    return catalog.latest_jobs(_job_log(spark, sf_dir), 20)


def unit_vectors(spark, sf_dir) -> DataFrame:
    e = inputs.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", dense.l2_normalized(F.col("embedding")).alias("v")).select(
        "vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.array_max("v"), 6).alias("largest")
    )


def partial_results(spark, sf_dir) -> DataFrame:
    """Turns as generated results with fields that are not wanted; every third one is no JSON."""
    raw = F.to_json(F.struct(F.col("text").alias("summary"), F.array("role").alias("open_questions"), F.lit(1).alias("other")))
    c = inputs.table(spark, sf_dir, "conversations").withColumn("raw", F.when(F.col("turn") % 3 == 2, F.lit("{")).otherwise(raw))
    r = c.withColumn("r", grounding.partial_result(F.col("raw")))
    return r.select("conv_id", "turn", F.md5("r.summary").alias("summary_digest"), F.size("r.open_questions").alias("questions"))


def manifest_shapes(spark, sf_dir) -> DataFrame:
    """Manifests with a broken time, hash or task id by rule."""
    c = inputs.table(spark, sf_dir, "conversations").where("turn = 0")
    odd = lambda n: F.col("conv_id") % n == 1
    m = c.select(
        F.when(odd(7), F.concat(_task(), F.lit("/.."))).otherwise(_task()).alias("task_id"),
        F.when(odd(5), "yesterday").otherwise("2026-01-02T03:04:05").alias("created_at"),
        F.create_map(F.lit("f"), F.when(odd(3), F.md5("text")).otherwise(F.upper(F.sha2("text", 256)))).alias("files"),
        F.length("text").alias("evidence_count"), F.when(odd(11), -1).otherwise(0).alias("context_count"), "conv_id",
    )
    return m.select("conv_id", gates.valid_manifest().alias("valid"))


def inconsistent_packs(spark, sf_dir) -> DataFrame:
    """Manifests that disagree with their task or the number of user or assistant turns."""
    c = inputs.table(spark, sf_dir, "conversations").withColumn("task_id", _task())
    one = c.groupBy("task_id", "conv_id").agg(
        F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a")
    )
    made = one.select(
        F.col("task_id").alias("pack_id"),
        F.when(F.col("conv_id") % 7 == 0, "other").otherwise(F.col("task_id")).alias("task_id"),
        (F.col("u") + F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0)).alias("evidence_count"),
        (F.col("a") + F.when(F.col("conv_id") % 5 == 0, 1).otherwise(0)).alias("context_count"),
    )
    return gates.pack_consistency(one, made, c.where("role = 'user'"), c.where("role = 'assistant'"))


def ready_packs(spark, sf_dir) -> DataFrame:
    c = inputs.table(spark, sf_dir, "conversations")
    n = F.length("text")
    name = F.when(n > 1500, "result/INVALID").when(n > 700, "result/DONE").otherwise("task.yaml")
    return gates.ready_for_import(gates.pack_status(c.select(_task().alias("task_id"), F.lit("completed").alias("place"), name.alias("name"))))


def task_summaries(spark, sf_dir) -> DataFrame:
    """Dialogues as results: assistant turns are claims, user turns open questions."""
    c = inputs.table(spark, sf_dir, "conversations")
    said = lambda role: F.collect_list(F.when(F.col("role") == role, F.col("turn")))
    r = c.groupBy(_task().alias("pack_id")).agg(
        F.lit("review").alias("task_type"), F.lit("q").alias("query"), F.lit("s").alias("summary"),
        said("assistant").alias("claims"), said("nobody").alias("tensions"), said("user").alias("open_questions"),
        F.first(F.lit(None).cast("array<int>")).alias("uncertainties"),
    )
    return gates.task_summaries(r)


def repaired_points(spark, sf_dir) -> DataFrame:
    """Vectors after repair: Spanish documents are gone, German ones have a vector too many, unlabelled ones none."""
    d = inputs.table(spark, sf_dir, "documents")
    rows = d.where("lang <> 'es'").select(F.col("doc_id").alias("document_id"), F.concat(_named(), F.lit(":1")).alias("id"))
    labelled = d.join(inputs.table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    point = lambda c: dense.point_id(c).alias("point_id")
    first = labelled.select(F.col("doc_id").alias("document_id"), point(F.concat(_named(), F.lit(":1"))), F.lit("old").alias("made"))
    extra = labelled.where("lang = 'de'").select(F.col("doc_id").alias("document_id"), point(F.concat(_named(), F.lit(":2"))), F.lit("old").alias("made"))
    fresh = rows.select("document_id", point(F.col("id")), F.lit("new").alias("made"))
    known = rows.select(F.col("document_id").alias("id"))
    return reconcile.repair_points(known, rows, first.unionByName(extra), fresh)


def corpus_report(spark, sf_dir) -> DataFrame:
    """Counts of a run over documents, pages, turns and vectors; labels give what was left out."""
    t = lambda name: inputs.table(spark, sf_dir, name)
    labels = t("labels")
    refused = labels.where("quality = 0").select(F.when(F.col("toxic") == 1, "toxic").otherwise("poor").alias("reason"))
    errors = labels.where("toxic = 1").select(F.when(F.col("quality") == 1, "bad_encoding").otherwise("gone").alias("error"))
    docs = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("plain_text"))
    return reconcile.corpus_report(
        docs, docs.select((F.col("id") - F.col("id") % 2).alias("id")), t("pages"), docs, t("conversations"), t("benchmark"),
        t("embeddings"), refused, errors,
    )


QUERIES = {
    f.__name__: f
    for f in (
        rejected_queries, run_catalog, new_tasks, last_deletions, job_log, recent_jobs, unit_vectors, partial_results,
        manifest_shapes, inconsistent_packs, ready_packs, task_summaries, repaired_points, corpus_report,
    )
}
