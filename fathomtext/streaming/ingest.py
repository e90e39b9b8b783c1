"""Continuous ingest: arriving rows or files, merged batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomtext.operators.changes import scan_diff
from fathomtext.session import ensure_checkpoint_dir, tune


def working_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"


def watch_files(
    spark: SparkSession, reconcile: Callable[[int], object], checkpoint: str, every: str = "300 seconds", once: bool = False
) -> StreamingQuery:
    """Run ``reconcile(batch id)`` on every tick of a clock.

    A tick compares the whole listing with the catalog, so edits, deletions and renames are
    found like new files.  With one kept checkpoint the batch ids go on counting.
    """
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = clock.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda _, batch_id: reconcile(batch_id))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def reconcile_batch(spark: SparkSession, roots: list[str], store: str, name: str, **options) -> Callable[[int], None]:
    """A reconcile for :func:`watch_files` whose version follows from the batch.

    A batch that is run again after it had published does nothing.  ``name`` is that of the
    watch; a watch with a new checkpoint needs a new one.
    """
    from fathomtext.plans.indexing import reconcile_files
    from fathomtext.sources.snapshots import current_version

    def run(batch_id: int) -> None:
        version = f"{name}-{batch_id:09d}"
        if current_version(spark, store) != version:
            reconcile_files(spark, roots, store, version, **options)

    return run


LISTING = "path string, size bigint, mtime_ms bigint, sha256 string, error string"
MANIFEST = "id string, path string, size bigint, mtime_ms bigint, sha256 string"


#: Folder beside the scans with a file for each that is complete.
ARRIVED = "arrived"


def announce_listing(spark: SparkSession, listings: str, name: str) -> None:
    """Tells :func:`track_listings` that the folder ``name`` of ``listings`` is complete."""
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("append").text(f"{listings}/{ARRIVED}")


def track_listings(spark: SparkSession, listings: str, folder: str) -> DataFrame:
    """States of every path in each listing that arrives, ``batch`` and the columns of ``scan_diff``.

    ``listings`` holds a folder of ``LISTING`` rows in Parquet for each scan, of any number of files; the stream follows
    the names that :func:`announce_listing` leaves when a folder is complete, one for each batch.  What is known of each path after a batch is a
    table of that batch: a path keeps its document id through edits and renames and loses it when it is gone.
    Both tables of a batch are replaced as a whole when it runs again, and it reads the table of the batch before.
    """
    tune(spark)

    def one(batch: DataFrame, batch_id: int) -> None:
        before = f"{folder}/known/batch={batch_id - 1}"
        known = spark.read.schema(MANIFEST).parquet(before) if batch_id else spark.createDataFrame([], MANIFEST)
        here = f"{folder}/states/batch={batch_id}"
        names = [r["value"] for r in batch.collect()]
        listing = spark.read.schema(LISTING).parquet(*[f"{listings}/{name}" for name in names])
        scan_diff(listing, known).write.mode("overwrite").parquet(here)
        states = spark.read.parquet(here).where("status <> 'DELETED'")
        named = states.select(
            F.coalesce("document_id", F.concat(F.lit(f"{batch_id}:"), F.md5("path"))).alias("id"), "path", "size", "mtime_ms", "sha256"
        )
        named.write.mode("overwrite").parquet(f"{folder}/known/batch={batch_id}")

    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{listings}/{ARRIVED}")
    query = (
        stream.writeStream.option("checkpointLocation", f"{folder}/offsets").foreachBatch(one).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", f"{folder}/states").parquet(f"{folder}/states")


def merge_batch(spark: SparkSession, target: str) -> Callable[[DataFrame, int], None]:
    """Writer of one batch: partial counts, replaced as a whole when retried."""

    def write(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("n_events"), F.max("event_id").alias("last_event")
        )
        part.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def stream_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Stream a Parquet file source to its end and read the merged result.

    Each batch owns one folder, so a batch that runs twice after a failure
    writes the same rows once.
    """
    tune(spark)
    folder = working_folder(spark)
    schema = spark.read.parquet(path).schema
    parent, name = path.rsplit("/", 1)
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent)
    query = (
        events.select("user_id", "event_id")
        .writeStream.option("checkpointLocation", f"{folder}/offsets")
        .foreachBatch(merge_batch(spark, f"{folder}/parts"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    parts = spark.read.parquet(f"{folder}/parts")
    return parts.groupBy("user_id").agg(F.sum("n_events").alias("n_events"), F.max("last_event").alias("last_event"))
