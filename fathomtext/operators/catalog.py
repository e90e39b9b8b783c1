"""Updates of the catalog tables as joins: old snapshot in, new snapshot out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def upsert(old: DataFrame, new: DataFrame, key: str = "id", kept: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows of ``new`` over rows of ``old``; the ``kept`` columns stay as first written."""
    before = old.select(key, *[F.col(c).alias(f"_{c}") for c in kept])
    fresh = new.join(before, key, "left")
    for c in kept:
        fresh = fresh.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(fresh.select(*new.columns))


def replace_children(old: DataFrame, new: DataFrame, changed: DataFrame, key: str = "document_id") -> DataFrame:
    """Drop every row of the changed documents and add the new ones."""
    return old.join(changed.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the documents ``gone(document_id)``."""
    ids = gone.select("document_id").distinct()
    out = {}
    for name, df in tables.items():
        key = "id" if name == "documents" else "document_id"
        out[name] = df.join(ids.withColumnRenamed("document_id", key), key, "left_anti").select(*df.columns)
    return out


def tombstones(log: DataFrame, deleted: DataFrame, documents: DataFrame, at: Column) -> DataFrame:
    """Deletion log with the newly deleted paths appended."""
    fresh = deleted.join(documents.select(F.col("id").alias("document_id"), F.col("sha256").alias("last_sha256")), "document_id").select(
        F.col("path").alias("source_path"), "document_id", "last_sha256", at.alias("deleted_at")
    )
    return log.select(*fresh.columns).unionByName(fresh)


def latest_tombstones(log: DataFrame) -> DataFrame:
    """The last deletion of each path."""
    return log.groupBy("source_path").agg(
        F.max_by(F.struct("document_id", "last_sha256", "deleted_at"), "deleted_at").alias("t")
    ).select("source_path", "t.*")


def latest_values(runs: DataFrame) -> DataFrame:
    """Current value per key of an append-only ``runs(key, value, at)`` table."""
    return runs.groupBy("key").agg(F.max_by("value", "at").alias("value"))


def latest_jobs(jobs: DataFrame, n: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def finish_jobs(jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """Job log with status and end time of the finished jobs filled in."""
    f = finished.select("id", F.col("status").alias("_s"), F.col("finished_at").alias("_f"), F.col("error").alias("_e"))
    return jobs.join(f, "id", "left").select(
        *[
            F.coalesce("_s", "status").alias("status") if c == "status"
            else F.coalesce("_f", "finished_at").alias("finished_at") if c == "finished_at"
            else F.coalesce("_e", "error").alias("error") if c == "error"
            else F.col(c)
            for c in jobs.columns
        ]
    )


def second_corpus_id(path: Column, root: str, prefix: str = "cog") -> Column:
    """Document id ``{prefix}:{relative path without extension}``."""
    rel = F.regexp_replace(F.substring(path, len(root) + 1, 1 << 20), r"^[/\\]+", "")
    return F.concat(F.lit(f"{prefix}:"), F.replace(F.regexp_replace(rel, r"(?<=[^/\\])\.[^./\\]*$", ""), F.lit("\\"), F.lit("/")))
