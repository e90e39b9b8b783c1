"""Agreement of catalog and indexes, repair sets and corpus counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomtext.functions.exprs import null_as
from fathomtext.operators.dense import point_id
from fathomtext.operators import chunking, structure
from fathomtext.sources.staging import staged


def _per_document(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))


def document_counts(
    documents: DataFrame, chunks: DataFrame, term_rows: DataFrame, gram_rows: DataFrame, points: DataFrame
) -> DataFrame:
    """Rows of each store per document, and whether they agree."""
    out = documents.select(F.col("id").alias("document_id"))
    for name, df in (("chunks", chunks), ("terms", term_rows), ("trigrams", gram_rows), ("points", points)):
        out = out.join(_per_document(df, name), "document_id", "left")
    out = out.na.fill(0)
    same = (F.col("chunks") == F.col("terms")) & (F.col("terms") == F.col("trigrams")) & (
        F.col("trigrams") == F.col("points")
    )
    return out.withColumn("ok", same)


def totals(chunks: DataFrame, term_rows: DataFrame, gram_rows: DataFrame, points: DataFrame) -> DataFrame:
    """Global counts of the stores and an equality flag, one row."""
    stores = (("chunks", chunks), ("terms", term_rows), ("trigrams", gram_rows), ("points", points))
    tagged = None
    for name, df in stores:
        part = df.select(F.lit(name).alias("store"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.agg(*[F.count_if(F.col("store") == n).alias(n) for n, _ in stores])
    return counts.withColumn(
        "consistent",
        (F.col("chunks") == F.col("terms"))
        & (F.col("terms") == F.col("trigrams"))
        & (F.col("trigrams") == F.col("points")),
    )


def orphan_points(points: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Points whose document is gone or whose id no chunk has."""
    expected = chunks.select(point_id(F.col("id")).alias("point_id"))
    no_document = points.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    no_chunk = points.join(expected, "point_id", "left_anti")
    cols = ["point_id", "document_id"]
    return no_document.select(cols).unionByName(no_chunk.select(cols)).distinct()


def documents_to_embed(documents: DataFrame, chunks: DataFrame, points: DataFrame) -> DataFrame:
    """Documents whose point count differs from their chunk count."""
    return (
        documents.select(F.col("id").alias("document_id"))
        .join(_per_document(chunks, "chunks"), "document_id", "left")
        .join(_per_document(points, "points"), "document_id", "left")
        .na.fill(0)
        .where(F.col("chunks") != F.col("points"))
    )


def repair_points(
    documents: DataFrame, chunks: DataFrame, points: DataFrame, embedded: DataFrame
) -> DataFrame:
    """The vector table after repair: orphans dropped, mismatches replaced.

    ``embedded`` holds fresh points of the chunks to embed, with the columns of
    ``points``.
    """
    stale = documents_to_embed(documents, chunks, points).select("document_id")
    kept = points.join(orphan_points(points, documents, chunks).select("point_id"), "point_id", "left_anti").join(
        stale, "document_id", "left_anti"
    )
    fresh = embedded.join(stale, "document_id", "left_semi")
    return kept.select(*points.columns).unionByName(fresh.select(*points.columns))


def catalog_generation(documents: DataFrame) -> DataFrame:
    """Document count and the oldest versions present."""
    return documents.agg(
        F.count(F.lit(1)).alias("documents"),
        F.min("parser_version").alias("parser_version"),
        F.min("chunker_version").alias("chunker_version"),
        F.min("schema_version").alias("schema_version"),
    )


def document_list(documents: DataFrame) -> DataFrame:
    return documents.orderBy("id")


def document_detail(documents: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with the number of their sections and chunks."""
    return (
        documents.join(_per_document(sections, "section_count").withColumnRenamed("document_id", "id"), "id", "left")
        .join(_per_document(chunks, "chunk_count").withColumnRenamed("document_id", "id"), "id", "left")
        .na.fill(0, ["section_count", "chunk_count"])
    )


def children_of(table: DataFrame, document_id: str) -> DataFrame:
    """Sections or chunks of one document in order."""
    return table.where(F.col("document_id") == document_id).orderBy("ordinal")


def chunk_with_title(chunks: DataFrame, documents: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.where(F.col("id") == chunk_id).join(
        documents.select(F.col("id").alias("document_id"), "title"), "document_id", "left"
    )


def corpus_report(
    files: DataFrame, documents: DataFrame, sections: DataFrame, chunks: DataFrame,
    term_rows: DataFrame, gram_rows: DataFrame, points: DataFrame, exclusions: DataFrame,
    errors: DataFrame, hard_max: int = 2200,
) -> DataFrame:
    """One long table ``measure, detail, n`` with the counts of a whole run."""

    def measure(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("measure"), null_as("string").alias("detail"), "n"
        )

    parts = [
        measure(files, "files"),
        measure(documents, "documents"),
        measure(sections, "sections"),
        measure(chunks, "chunks"),
        measure(term_rows, "terms"),
        measure(gram_rows, "trigrams"),
        measure(points, "points"),
        measure(exclusions, "skipped"),
        measure(errors, "failed"),
        measure(errors.where(F.col("error") == "bad_encoding"), "encoding_failures"),
        measure(chunks.where(F.length("plain_text") > hard_max), "oversized_chunks"),
        measure(documents.groupBy("id").count().where("count > 1"), "duplicate_document_ids"),
        exclusions.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("skipped_by_reason").alias("measure"), F.col("reason").alias("detail"), "n"
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sampled_recheck(
    texts: DataFrame, documents: DataFrame, sections: DataFrame, chunks: DataFrame, n: int = 50, seed: int = 0
) -> DataFrame:
    """A seeded sample of the catalog against a fresh parse of its texts: one row a document with what differs.

    ``texts(document_id, text)``, ``documents(id, title)`` and the stored section and chunk tables.  Only the sampled
    texts are parsed, and each stored table is read once.  ``*_missing`` counts rows that the store lacks, ``*_extra``
    rows that only the store has.
    """
    draw = F.md5(F.concat_ws(":", F.col("document_id").cast("string"), F.lit(str(seed))))
    sample = texts.orderBy(draw, "document_id").limit(n)
    parsed = staged(structure.parse_documents(sample), "recheck")
    ids = F.broadcast(parsed.select(F.col("document_id").cast("string").alias("document_id")))

    def differences(name: str, old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
        key = F.col("document_id").cast("string").alias("document_id")
        was = staged(old.select(key, *columns).join(ids, "document_id", "left_semi"), f"stored-{name}")
        now = new.select(key, *columns)
        count = lambda rows, side: rows.groupBy("document_id").agg(F.count(F.lit(1)).alias(f"{name}_{side}"))
        missing, extra = count(now.exceptAll(was), "missing"), count(was.exceptAll(now), "extra")
        return missing.join(extra, "document_id", "full_outer")

    of_sections = differences(
        "sections", sections, structure.sections_table(parsed), ["section_id", "heading", "level", "start_line", "end_line"]
    )
    of_chunks = differences("chunks", chunks, chunking.chunk_table(parsed), ["id", "content_type", "content_hash", "start_line", "end_line"])
    fresh = parsed.select(
        F.col("document_id").cast("string").alias("document_id"),
        F.coalesce(F.element_at("metadata", F.lit("title")), F.col("title")).alias("fresh_title"),
    )
    stored = documents.select(F.col("id").cast("string").alias("document_id"), F.col("title").alias("stored_title"))
    stored = stored.join(ids, "document_id", "left_semi")
    counts = [f"{name}_{side}" for name in ("sections", "chunks") for side in ("missing", "extra")]
    out = fresh.join(stored, "document_id", "left").join(of_sections, "document_id", "left").join(of_chunks, "document_id", "left")
    return out.select(
        "document_id", F.col("stored_title").eqNullSafe(F.col("fresh_title")).alias("title_ok"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    ).withColumn("passed", F.col("title_ok") & F.forall(F.array(*counts), lambda x: x == 0))
