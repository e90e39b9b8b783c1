"""Published catalog snapshots that share what did not change.

Every table of a snapshot lies in buckets of its document ids, a folder of Parquet files
each.  A manifest names the folder of every bucket; a new version writes the buckets of
the documents that changed and takes over the folders of all others.  Readers follow the
newest row of the pointer table to a manifest, so they see all tables of a version or
none, and a run that fails before its pointer is written leaves the old version in place.

Logs (deletions, scans, jobs) are written by version too and count only once the pointer names
their version: a run that is repeated after a failure replaces its own rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fathomtext.sources.files import _exists

BUCKETS = 64
WRITERS = 6
MANIFEST = "name string, bucket int, path string, buckets int, columns string"


@dataclass
class Change:
    """New rows of some buckets of a table; without ``touched`` they are all rows of all buckets."""

    rows: DataFrame
    touched: set[int] | None = None


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def key_of(name: str, columns: list[str]) -> str:
    return "id" if name == "documents" else "document_id" if "document_id" in columns else columns[0]


def with_bucket(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", bucket_of(F.col(key), buckets))


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _written_buckets(spark: SparkSession, folder: str) -> list[int]:
    """Buckets that a write has left below a folder; empty ones have none."""
    fs, p = _file_system(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


def manifest(spark: SparkSession, root: str, version: str) -> list:
    """Rows (name, bucket, path, buckets, columns) of a version: tables times buckets, whatever the data."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest/{version}").collect()


def publish(
    spark: SparkSession,
    root: str,
    version: str,
    tables: dict[str, DataFrame | Change],
    buckets: int = BUCKETS,
    base: str | None = None,
    derived: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] | None = None,
    logs: dict[str, DataFrame] | None = None,
) -> None:
    """Write the changed buckets of a snapshot, its logs and its manifest, then switch the pointer to it.

    ``base`` is the version that untouched buckets are taken from, with its number of buckets.  ``derived`` tables follow from
    the rows of one bucket of another table, given with the column ``bucket``.
    """
    if version == current_version(spark, root):
        raise ValueError(f"{version} is already published")
    before = manifest(spark, root, base) if base else []
    buckets = before[0]["buckets"] if before else buckets
    rows = []

    def entries(name: str, folder: str, columns: str, touched: set[int] | None, wrote: bool) -> None:
        mine = [(name, b, f"{folder}/bucket={b}", buckets, columns) for b in (_written_buckets(spark, folder) if wrote else [])]
        if touched is not None:
            mine += [tuple(r) for r in before if r["name"] == name and r["bucket"] is not None and r["bucket"] not in touched]
        # A table without rows keeps its columns.
        rows.extend(mine or [(name, None, None, buckets, columns)])

    def write(df: DataFrame, folder: str) -> None:
        # A rebalance splits large buckets and joins small ones by size.
        df.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(folder)

    def table(name: str, change: DataFrame | Change) -> None:
        change = change if isinstance(change, Change) else Change(change)
        folder, df = f"{root}/data/{version}/{name}", change.rows
        wrote = change.touched is None or bool(change.touched)
        if wrote:
            write(with_bucket(df, key_of(name, df.columns), buckets), folder)
        entries(name, folder, df.schema.json(), change.touched, wrote)
        for made, (source, follow) in (derived or {}).items():
            if source != name:
                continue
            target = f"{root}/data/{version}/{made}"
            made_rows = follow(df.withColumn("bucket", F.lit(0)))
            columns = T.StructType([f for f in made_rows.schema.fields if f.name != "bucket"]).json()
            if wrote and _written_buckets(spark, folder):
                write(follow(spark.read.parquet(folder)), target)
                entries(made, target, columns, change.touched, True)
            else:
                entries(made, target, columns, change.touched, False)
    # Tables do not depend on each other: their jobs share the cluster.
    with ThreadPoolExecutor(WRITERS) as pool:
        for done in [pool.submit(table, *item) for item in tables.items()]:
            done.result()
    for name, df in (logs or {}).items():
        df.write.mode("overwrite").parquet(f"{root}/_log/{name}/version={version}")
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/_manifest/{version}")
    spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("published_at")
    ).coalesce(1).write.mode("append").parquet(f"{root}/_pointer")


def current_version(spark: SparkSession, root: str) -> str | None:
    if not _exists(spark, f"{root}/_pointer"):
        return None
    row = spark.read.parquet(f"{root}/_pointer").agg(F.max_by("version", "published_at").alias("v")).first()
    return row["v"]


def read_table(
    spark: SparkSession, root: str, name: str, version: str | None = None, buckets: set[int] | None = None
) -> DataFrame:
    """A table of a version, or some of its buckets: no other folder is opened."""
    version = version or current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no snapshot below {root}")
    rows = [r for r in manifest(spark, root, version) if r["name"] == name]
    if not rows:
        raise KeyError(f"version {version} has no table {name}")
    schema = T.StructType.fromJson(json.loads(rows[0]["columns"]))
    paths = [r["path"] for r in rows if r["path"] and (buckets is None or r["bucket"] in buckets)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_log(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Rows of a log that published versions have written, with their ``version``."""
    folder = f"{root}/_log/{name}"
    if not _exists(spark, folder) or not _exists(spark, f"{root}/_pointer"):
        return spark.createDataFrame([], f"{schema}, version string")
    rows = spark.read.schema(f"{schema}, version string").option("basePath", folder).parquet(folder)
    return rows.join(spark.read.parquet(f"{root}/_pointer").select("version").distinct(), "version", "left_semi")


def unused_folders(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Bucket folders that none of the last ``keep`` versions names; a caller may delete them."""
    newest = spark.read.parquet(f"{root}/_pointer").orderBy(F.desc("published_at")).limit(keep).collect()
    named = {r["path"] for v in newest for r in manifest(spark, root, v["version"])}
    fs, data = _file_system(spark, f"{root}/data")
    out = []
    for version in fs.listStatus(data):
        for table in fs.listStatus(version.getPath()):
            # Paths as they were given, not as the file system spells them.
            folder = f"{root}/data/{version.getPath().getName()}/{table.getPath().getName()}"
            out += [f"{folder}/bucket={b}" for b in _written_buckets(spark, folder)]
    return [p for p in out if p not in named]
