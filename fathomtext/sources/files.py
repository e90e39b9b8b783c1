"""Reading source files, JSON records and marker listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BOM = "﻿"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _wanted(extensions: tuple[str, ...]) -> Column:
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1))
    return suffix.isin(*extensions) & ~F.startswith(name, F.lit("~$"))


def list_files(spark: SparkSession, roots: list[str], extensions: tuple[str, ...] = (".md",)) -> DataFrame:
    """Path, size and mtime of the files below the roots; content is not read.

    Column pruning keeps the bytes unread, so the listing costs metadata only.
    """
    for root in roots:
        if not _exists(spark, root):
            raise FileNotFoundError(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    return files.where(_wanted(extensions)).select(
        "path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms")
    )


def list_named_directories(
    spark: SparkSession, root: str, include: list[str], extensions: tuple[str, ...] = (".md",)
) -> DataFrame:
    """Files below named sub-directories; a missing one is empty, a missing root an error."""
    if not _exists(spark, root):
        raise FileNotFoundError(root)
    present = [f"{root}/{d}" for d in include if _exists(spark, f"{root}/{d}")]
    if not present:
        return spark.createDataFrame([], "path string, size bigint, mtime_ms bigint")
    return list_files(spark, present, extensions)


def read_contents(spark: SparkSession, roots: list[str], paths: DataFrame) -> DataFrame:
    """Content, hash and decoded text of the given ``paths(path, size, mtime_ms)``.

    The source prunes files by time and length before it opens them, so the
    range of the wanted files is handed to it first: what has not changed since
    the last run is not read.  Bytes that are not UTF-8 become rows with
    ``error`` and no text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    span = paths.agg(
        F.min("mtime_ms").alias("t0"), F.max("mtime_ms").alias("t1"), F.min("size").alias("n0"), F.max("size").alias("n1")
    ).first()
    if span["t0"] is None:
        files = files.where(F.lit(False))
    else:
        files = files.where(
            (F.col("modificationTime") >= F.timestamp_millis(F.lit(span["t0"])))
            & (F.col("modificationTime") < F.timestamp_millis(F.lit(span["t1"] + 1)))
            & F.col("length").between(span["n0"], span["n1"])
        )
    chosen = files.join(paths.select("path"), "path", "left_semi")
    text = F.col("content").cast("string")
    ok = F.is_valid_utf8(text)
    return chosen.select(
        "path",
        F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("mtime_ms"),
        F.sha2("content", 256).alias("sha256"),
        F.when(ok, text).alias("text"),
        F.when(~ok, "bad_encoding").alias("error"),
    )


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON Lines with an explicit schema; blank and malformed rows are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON document per file, byte-order mark allowed; ``value`` is null when invalid."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    raw = F.col("content").cast("string")
    text = F.when(F.startswith(raw, F.lit(BOM)), F.substring(raw, 2, 1 << 30)).otherwise(raw)
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    parsed = F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, ddl))
    return files.select("path", parsed.alias("value"))


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Rows as JSON Lines; with ``partition_by`` a folder for each of its values.

    A later write replaces the folders it has rows for and leaves all others, so a run that repeats some tasks
    replaces only theirs.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.json(path)


def read_json_folders(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`write_json` has written by folder, the folder columns being part of the ``schema``."""
    return spark.read.schema(schema).option("basePath", path).json(path)


def _runs(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Folders of the runs below a path and whether each was finished."""
    if not _exists(spark, path):
        return []
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted((n, _exists(spark, f"{path}/{n}/_SUCCESS")) for n in names if n.startswith("run="))


def write_run(df: DataFrame, path: str) -> None:
    """Rows of a run as JSON Lines in a folder of the run; see :func:`read_runs`.

    It makes a file for each partition, however many tasks the run has, and touches nothing written before.
    """
    last = max((int(name.removeprefix("run=")) for name, _ in _runs(df.sparkSession, path)), default=-1)
    df.write.json(f"{path}/run={last + 1:06d}")


def read_runs(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """What :func:`write_run` has written: of each key the rows of the last finished run that has any.

    So a run that repeats some tasks replaces only theirs.
    """
    done = [f"{path}/{name}" for name, finished in _runs(spark, path) if finished]
    if not done:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, run int").option("basePath", path).json(done)
    last = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max("run").alias("_run"))
    same = F.col("run") == F.col("_run")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(last, same, "left_semi").drop("run")
