"""From files to a published catalog: diff, admit, parse, chunk, index, publish."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomtext.functions.text import TermTrie
from fathomtext.operators import admission, catalog, changes, chunking, dense, lexical, structure
from fathomtext.operators.admission import file_name
from fathomtext.sources import files, snapshots

PARSER_VERSION = "1"
SCHEMA_VERSION = "1"


def build_rows(
    parsed: DataFrame,
    embed: Callable[[Column], Column] = dense.hashed_embedding,
    now: Column | None = None,
    stage: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
    domain_terms: Column | TermTrie | None = None,
) -> dict[str, DataFrame]:
    """All tables of the parsed ``texts(document_id, path, size, mtime_ms, sha256)``.

    ``stage`` may write the chunks once and give back a reader, so that the tables built
    from them do not repeat the work.
    """
    now = F.current_timestamp().cast("string") if now is None else now
    meta = lambda k: F.coalesce(F.element_at("metadata", F.lit(k)), F.lit(""))
    documents = parsed.select(
        F.col("document_id").alias("id"),
        structure.report_code(F.col("metadata")).alias("report_code"),
        F.coalesce(F.element_at("metadata", F.lit("title")), F.col("title")).alias("title"),
        meta("domain").alias("domain"),
        meta("research_method").alias("research_method"),
        meta("author").alias("author"),
        meta("completed_at").alias("completed_at"),
        meta("status").alias("status"),
        F.col("path").alias("source_path"),
        file_name(F.col("path")).alias("file_name"),
        F.col("size").alias("file_size"),
        F.col("mtime_ms").alias("file_mtime_ms"),
        "sha256",
        F.lit(PARSER_VERSION).alias("parser_version"),
        F.lit(chunking.CHUNKER_VERSION).alias("chunker_version"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        now.alias("indexed_at"),
        now.alias("created_at"),
    )
    chunks = stage("chunks", chunking.chunk_table(parsed, domain_terms=domain_terms))
    terms = lexical.term_index(chunks, extra=["document_id"])
    grams = lexical.gram_index(chunks, extra=["document_id"])
    facts = documents.select(F.col("id").alias("document_id"), "domain", "completed_at")
    vectors = chunks.join(facts, "document_id", "left").select(
        dense.point_id(F.col("id")).alias("point_id"), F.col("id").alias("chunk_id"), "document_id", "section_id",
        "content_type", "evidence_level", "domain", "completed_at", embed(F.col("embedding_text")).alias("embedding"),
    )
    heads = chunking.section_embedding_rows(parsed)
    section_vectors = heads.select(
        dense.section_point_id(F.col("document_id"), F.col("section_id")).alias("point_id"), "section_id", "document_id",
        "heading", "section_type", embed(F.col("embedding_text")).alias("embedding"),
    )
    return {
        "documents": documents,
        "sections": structure.sections_table(parsed),
        "chunks": chunks,
        "postings": terms.postings,
        "term_lengths": terms.lengths,
        "grams": grams.grams,
        "gram_lengths": grams.lengths,
        "vectors": vectors,
        "section_vectors": section_vectors,
    }


#: Tables that follow from the rows of one bucket of another table.
DERIVED = {
    "term_blocks": ("postings", lambda df: lexical.term_stats(df, "bucket")),
    "gram_blocks": ("grams", lambda df: lexical.gram_stats(df, "bucket")),
}
DELETIONS = "source_path string, document_id string, last_sha256 string, deleted_at string"
SCANS = "status string, n bigint, at string"
JOBS = "id string, kind string, status string, created_at string, finished_at string, error string"


def reconcile_files(
    spark: SparkSession, roots: list[str], store: str, version: str,
    embed: Callable[[Column], Column] = dense.hashed_embedding, rebuild: bool = False,
    admit: bool = True, domain_terms: Column | TermTrie | None = None, only: list[str] | None = None,
    buckets: int = snapshots.BUCKETS,
) -> DataFrame:
    """Bring the catalog in line with the files and publish a new snapshot.

    Only paths whose size or mtime changed are read, once: hash and text of a file come from
    the same read, which is written before anything else looks at it; paths that admission refuses by their name are not
    read at all.  Each changed file is parsed once.  The new version writes the buckets of the documents that changed, and its
    deletions, scan and job rows with them.  Returns the states; a run that finds nothing to do publishes nothing.
    ``rebuild`` starts from an empty catalog.  ``only`` names documents to be read again
    whether or not their files changed; nothing else is looked at.  ``buckets`` holds for a new catalog.
    """
    current = snapshots.current_version(spark, store)
    if version == current:
        raise ValueError(f"{version} is already published")
    known = None if rebuild else current
    read = lambda name, some=None: snapshots.read_table(spark, store, name, known, some)
    started = spark.range(1).select(F.current_timestamp().cast("string")).first()[0]
    if known:
        manifest = read("documents").select(
            "id", F.col("source_path").alias("path"), F.col("file_size").alias("size"),
            F.col("file_mtime_ms").alias("mtime_ms"), "sha256",
        )
    else:
        manifest = spark.createDataFrame([], "id string, path string, size bigint, mtime_ms bigint, sha256 string")
    listing = files.list_files(spark, roots)
    if only is not None:
        # An unknown size and hash make a file of these documents look modified.
        manifest = manifest.where(F.col("id").isin(only)).select(
            "id", "path", *[F.lit(None).cast(t).alias(c) for c, t in (("size", "bigint"), ("mtime_ms", "bigint"), ("sha256", "string"))]
        )
        listing = listing.join(manifest.select("path"), "path", "left_semi")

    def stage(name: str, df: DataFrame) -> DataFrame:
        place = f"{store}/_staged/{version}/{name}"
        df.write.mode("overwrite").parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    wanted = changes.needs_hash(listing, manifest)
    if admit:
        wanted = wanted.where(admission.exclusion_reason(F.col("path")).isNull())
    contents = stage("contents", files.read_contents(spark, roots, wanted))
    # A file edited after the listing is judged by what was read, its size and time included.
    now = contents.select("path", F.col("size").alias("_size"), F.col("mtime_ms").alias("_mtime"), "sha256", "error")
    hashed = listing.join(now, "path", "left").select(
        "path", F.coalesce("_size", "size").alias("size"), F.coalesce("_mtime", "mtime_ms").alias("mtime_ms"), "sha256", "error"
    )
    # The states steer every later step: they are fixed before anything is written.
    states = stage("states", changes.scan_diff(hashed, manifest))
    work = states.where("status NOT IN ('UNCHANGED', 'ERROR')")
    if admit:
        work = work.where((F.col("status") != "NEW") | admission.exclusion_reason(F.col("path")).isNull())
    if known and not work.limit(1).count():
        return states
    changed = states.where("status IN ('NEW', 'MODIFIED')").join(contents.select("path", "text"), "path")
    parsed = stage("parsed", structure.parse_documents(changed.drop("document_id", "status", "renamed_from", "error")).drop("text"))
    coded = parsed.withColumn("report_code", structure.report_code(F.col("metadata")))
    before = None
    if known:
        before = read("documents").select("id", "sha256", "source_path")
    if admit:
        assignments, _ = admission.index_plan(coded.select("path", "report_code", "sha256"), before)
    else:
        named = coded.select(
            "path", F.coalesce("report_code", admission.stem_of(F.col("path"))).alias("default_id"), "sha256"
        )
        assignments, _ = admission.assign_ids(named, before)
    given = stage("assigned", assignments.select("path", "document_id"))
    fresh = build_rows(parsed.join(given, "path"), embed, stage=stage, domain_terms=domain_terms)
    tables: dict[str, DataFrame | snapshots.Change] = dict(fresh)
    ended = F.current_timestamp().cast("string")
    logs = {
        "scans": states.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("at", ended),
        "jobs": spark.range(1).select(
            F.lit(version).alias("id"), F.lit("reindex" if only is not None else "rebuild" if rebuild else "reconcile").alias("kind"),
            F.lit("COMPLETED").alias("status"), F.lit(started).alias("created_at"), ended.alias("finished_at"), F.lit(None).cast("string").alias("error"),
        ),
    }
    if known:
        size = snapshots.manifest(spark, store, known)[0]["buckets"]
        gone = states.where("status = 'DELETED'").select("document_id")
        # A modified file that got another id leaves its old id behind.
        moved_on = states.where("status = 'MODIFIED'").select("document_id")
        replaced = stage("replaced", given.select("document_id").unionByName(gone).unionByName(moved_on).distinct())
        renamed = states.where("status = 'RENAMED'").select("document_id")

        def touched(ids: DataFrame) -> set[int]:
            """As many numbers as there are buckets at most."""
            return {r["b"] for r in ids.select(snapshots.bucket_of(F.col("document_id"), size).alias("b")).distinct().collect()}

        parts = {name: touched(replaced.unionByName(renamed) if name == "documents" else replaced) for name in fresh}
        old = {name: read(name, parts[name]) for name in fresh}
        old["documents"] = changes.renamed_documents(old["documents"], states)
        kept = catalog.cascade_delete(old, replaced)
        created = old["documents"].select("id", F.col("created_at").alias("_c"))
        fresh["documents"] = (
            fresh["documents"].join(created, "id", "left").withColumn("created_at", F.coalesce("_c", "created_at")).drop("_c")
        )
        tables = {
            name: snapshots.Change(kept[name].select(*df.columns).unionByName(df), parts[name]) for name, df in fresh.items()
        }
        lost = states.where("status = 'DELETED'").select("path", "document_id")
        logs["deletions"] = catalog.tombstones(spark.createDataFrame([], DELETIONS), lost, before, ended)
    snapshots.publish(spark, store, version, tables, buckets, known, DERIVED, logs)
    return states


def reindex_document(spark: SparkSession, roots: list[str], store: str, version: str, document_id: str, **options) -> DataFrame:
    """Read, parse and index one document again; only its bucket is written."""
    return reconcile_files(spark, roots, store, version, only=[document_id], **options)


def deletions(spark: SparkSession, store: str) -> DataFrame:
    """The last deletion of each path, from published runs."""
    return catalog.latest_tombstones(snapshots.read_log(spark, store, "deletions", DELETIONS))


def last_scan(spark: SparkSession, store: str) -> DataFrame:
    """Counts by status of the newest published run."""
    scans = snapshots.read_log(spark, store, "scans", SCANS)
    return scans.where(F.col("version") == F.lit(snapshots.current_version(spark, store))).select("status", "n", "at")


def jobs(spark: SparkSession, store: str, n: int = 20) -> DataFrame:
    """The newest published runs."""
    return catalog.latest_jobs(snapshots.read_log(spark, store, "jobs", JOBS), n)


def open_index(spark: SparkSession, store: str, domain_terms: Column | TermTrie | None = None):
    """A published snapshot as a searchable corpus; the domain terms are those it was built with."""
    from fathomtext.plans.search import CorpusIndex

    version = snapshots.current_version(spark, store)
    read = lambda name: snapshots.read_table(spark, store, name, version)
    chunks = read("chunks")
    texts = chunks.select(
        F.col("id").alias("chunk_id"), F.lower("heading_path").alias("heading"), F.lower("raw_markdown").alias("body")
    )
    return CorpusIndex(
        chunks=chunks,
        documents=read("documents"),
        terms=lexical.TermIndex(read("postings"), read("term_lengths"), lexical.whole_stats(read("term_blocks"))),
        grams=lexical.GramIndex(
            read("grams"), texts, read("gram_lengths"), read("gram_blocks").groupBy("gram").agg(F.sum("n").alias("n"))
        ),
        vectors=read("vectors"),
        section_vectors=read("section_vectors"),
        domain_terms=domain_terms,
    )
