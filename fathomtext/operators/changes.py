"""Comparing a file listing with the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomtext.functions.skew import lookup_join


def needs_hash(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths whose content must be read: unknown, or size or mtime differs.

    ``listing(path, size, mtime_ms)``, ``manifest(id, path, size, mtime_ms, sha256)``.
    """
    m = manifest.select("path", F.col("size").alias("m_size"), F.col("mtime_ms").alias("m_mtime"))
    same = (F.col("size") == F.col("m_size")) & (F.col("mtime_ms") == F.col("m_mtime"))
    return listing.join(m, "path", "left").where(~F.coalesce(same, F.lit(False))).select(*listing.columns)


def scan_diff(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """State of every path: NEW, UNCHANGED, MODIFIED, RENAMED, DELETED or ERROR.

    ``listing(path, size, mtime_ms, sha256, error)``; the hash may be null where
    size and mtime agree with the manifest.  Two new files may both claim one
    vanished path as their origin.
    """
    m = manifest.select(
        "path", F.col("id").alias("document_id"), F.col("size").alias("m_size"),
        F.col("mtime_ms").alias("m_mtime"), F.col("sha256").alias("m_sha"), F.lit(True).alias("known"),
    )
    both = listing.withColumn("on_disk", F.lit(True)).join(m, "path", "full_outer")
    untouched = (F.col("size") == F.col("m_size")) & (F.col("mtime_ms") == F.col("m_mtime"))
    status = (
        F.when(F.col("error").isNotNull(), "ERROR")
        .when(F.col("on_disk").isNull(), "VANISHED")
        .when(F.col("known").isNull(), "NEW")
        .when(untouched | (F.col("sha256") == F.col("m_sha")), "UNCHANGED")
        .otherwise("MODIFIED")
    )
    states = both.select(
        "path", status.alias("status"), "size", "mtime_ms",
        F.coalesce("sha256", F.when(untouched, F.col("m_sha"))).alias("sha256"),
        "m_sha", "document_id", "error",
    )
    gone = (
        states.where("status = 'VANISHED'")
        .groupBy(F.col("m_sha").alias("sha256"))
        .agg(F.min(F.struct("path", "document_id")).alias("origin"))
        .where(F.col("sha256").isNotNull())
    )
    new = states.where("status = 'NEW'").drop("document_id", "m_sha")
    moved = lookup_join(new, gone, ["sha256"], "path", "left").select(
        "path",
        F.when(F.col("origin").isNull(), "NEW").otherwise("RENAMED").alias("status"),
        "size", "mtime_ms", "sha256",
        F.col("origin.path").alias("renamed_from"),
        F.col("origin.document_id").alias("document_id"),
        "error",
    )
    rest = states.where("status NOT IN ('NEW', 'VANISHED')").select(
        "path", "status", "size", "mtime_ms", "sha256", F.lit(None).cast("string").alias("renamed_from"),
        "document_id", "error",
    )
    claimed = moved.where("status = 'RENAMED'").select(F.col("renamed_from").alias("path")).distinct()
    deleted = states.where("status = 'VANISHED'").join(claimed, "path", "left_anti").select(
        "path", F.lit("DELETED").alias("status"), "size", "mtime_ms",
        F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("renamed_from"),
        "document_id", "error",
    )
    return rest.unionByName(moved).unionByName(deleted)


def status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def renamed_documents(documents: DataFrame, states: DataFrame) -> DataFrame:
    """Documents with the path, name and mtime of their new place."""
    moved = states.where("status = 'RENAMED'").groupBy("document_id").agg(
        F.max(F.struct("path", "mtime_ms")).alias("to")
    )
    return (
        documents.join(moved.withColumnRenamed("document_id", "id"), "id", "left")
        .withColumn("source_path", F.coalesce("to.path", "source_path"))
        .withColumn("file_name", F.coalesce(F.element_at(F.split("to.path", r"[/\\]"), -1), "file_name"))
        .withColumn("file_mtime_ms", F.coalesce("to.mtime_ms", "file_mtime_ms"))
        .drop("to")
    )
