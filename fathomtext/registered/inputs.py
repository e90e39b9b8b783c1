"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from fathomtext.operators import lexical
from fathomtext.session import tune
from fathomtext.sources.staging import staged
from fathomtext.streaming.ingest import working_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that comes in so few files that half of the cores would idle is spread over them.

    Spreading writes the whole table to the disks at each read, so it has to gain more than that.
    """
    tune(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * len(df.inputFiles()) <= cores else df


def small_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_types(df: DataFrame) -> DataFrame:
    """Integers as bigint, so that both engines name the same types."""
    return df.select(
        *[
            F.col(f.name).cast("bigint").alias(f.name)
            if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of ``benchmark`` as a query batch."""
    return small_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk with the columns of the chunk table."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("document_id"),
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("section_id"),
        F.lit("").alias("heading_path"),
        F.col("lang").alias("content_type"),
        F.lit(None).cast("int").alias("evidence_level"),
        F.col("text").alias("plain_text"),
        F.lit(1).alias("start_line"),
        F.size(F.split("text", "\n")).alias("end_line"),
    )


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of the documents; the title is the first line."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("domain"),
        F.lit(None).cast("string").alias("completed_at"),
    )


#: Folders of the indexes built by this process, by application and input folder.
_INDEXES: dict[tuple[str, str], str] = {}


def lexical_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Postings of the documents with their statistics, built once for a session and input folder, then read."""
    tune(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        folder = working_folder(spark)
        chunks = document_chunks(spark, sf_dir)
        write = lambda name, df: df.write.parquet(f"{folder}/{name}")
        terms = lexical.term_index(chunks, text_col="plain_text", extra=["content_type"])
        write("postings", terms.postings)
        write("term_lengths", terms.lengths)
        write("term_stats", lexical.term_stats(spark.read.parquet(f"{folder}/postings")))
        _INDEXES[key] = folder
    names = ("postings", "term_lengths", "term_stats")
    return {name: spark.read.parquet(f"{_INDEXES[key]}/{name}") for name in names}


def lexical_index(
    spark: SparkSession, sf_dir: str, chunk_id: Column | None = None
) -> tuple[lexical.TermIndex, lexical.GramIndex]:
    """The documents for both searches; ``chunk_id`` may name chunks by ``chunk_id`` and ``content_type``."""
    terms, grams = term_texts(spark, sf_dir), gram_texts(spark, sf_dir)
    named = lambda df: df if chunk_id is None else df.withColumn("chunk_id", chunk_id)
    return (
        lexical.TermIndex(None, named(terms.lengths), None, named(terms.texts)),
        lexical.GramIndex(None, named(grams.texts), named(grams.lengths)),
    )


def term_texts(spark: SparkSession, sf_dir: str) -> lexical.TermIndex:
    """The words of the documents, read for each batch; the postings of ``lexical_tables`` are not needed for it."""
    return lexical.term_texts(document_chunks(spark, sf_dir), text_col="plain_text", extra=["content_type"])


def gram_texts(spark: SparkSession, sf_dir: str) -> lexical.GramIndex:
    """The documents for substring search; their texts are read for each batch, trigrams are not kept."""
    index = lexical.gram_index(document_chunks(spark, sf_dir), text_col="plain_text", extra=["content_type"])
    return lexical.GramIndex(None, index.texts, index.lengths)


def terms_list(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return lexical.search_terms(lexical.query_phrases(queries(spark, sf_dir)), term_texts(spark, sf_dir), k)


def grams_list(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return lexical.search_substrings(lexical.query_substrings(queries(spark, sf_dir)), gram_texts(spark, sf_dir), k)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a query passage word for word."""
    texts = document_chunks(spark, sf_dir).select(F.col("id").alias("chunk_id"), "plain_text")
    # Metrics meet the truth several times; the few pairs are written, so that the texts are read once.
    return staged(lexical.substring_truth(queries(spark, sf_dir), gram_texts(spark, sf_dir), texts), "truth")


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth as judgments: grade 3 for documents labelled good, else 2."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    return (
        truth(spark, sf_dir)
        .join(labels, "chunk_id", "left")
        .select(
            "query_id",
            F.col("chunk_id").cast("string").alias("section_id"),
            (F.lit(2) + F.coalesce("quality", F.lit(0))).alias("grade"),
        )
    )


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label: ``query_id, embedding``."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("embedding")
    ).withColumnRenamed("label", "query_id")


def marked_documents(spark: SparkSession, sf_dir: str, plain: bool = False) -> DataFrame:
    """Documents as Markdown: the first line is the title, short lines are headings.

    A later line under 40 characters is a level-2 heading, one under 80 a
    level-3 heading; other lines are paragraphs of their own, with ``plain`` also
    those that begin with ``#``, which get a blank in front.
    """
    d = table(spark, sf_dir, "documents")
    lines = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.concat(
            F.when(i == 0, "# ")
            .when((F.length(l) > 0) & (F.length(l) < 40), "## ")
            .when((F.length(l) >= 40) & (F.length(l) < 80), "### ")
            .when(F.lit(plain) & F.startswith(l, F.lit("#")), " ")
            .otherwise(""),
            l,
        ),
    )
    return d.select(F.col("doc_id").alias("document_id"), F.array_join(lines, "\n").alias("text"))


def paragraph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a blank line after every line, so each is a paragraph."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown: h1 becomes the title, p and li become paragraphs."""
    p = table(spark, sf_dir, "pages")
    html = F.col("html")
    for pattern, kept in (
        (r"(?s)<script.*?</script>", ""),
        (r"<h1[^>]*>", "\n# "),
        (r"</?(?:p|li|ul|h1|br)[^>]*>", "\n"),
        (r"<[^>]+>", ""),
    ):
        html = F.regexp_replace(html, pattern, kept)
    return p.select(F.col("page_id").alias("document_id"), html.alias("text"))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A listing of all documents and an older catalog of the labelled ones.

    In the catalog, toxic documents had other content, and documents of low
    quality lay at another path.
    """
    d = table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    labels = table(spark, sf_dir, "labels")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")))
    size = F.octet_length("text").cast("long")
    listing = d.select(
        path.alias("path"), size.alias("size"), (F.col("doc_id") * 1000).alias("mtime_ms"),
        F.col("sha").alias("sha256"), F.lit(None).cast("string").alias("error"),
    )
    old = d.join(labels, "doc_id")
    manifest = old.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("quality") == 0, F.concat(F.lit("old/"), path)).otherwise(path).alias("path"),
        (size + F.col("toxic")).alias("size"),
        (F.col("doc_id") * 1000).alias("mtime_ms"),
        F.when(F.col("toxic") == 1, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("sha")).alias("sha256"),
    )
    return listing, manifest


def exchanges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Dialogues as tasks: user turns are evidence, assistant turns are claims.

    A claim cites the user turn before it; its state follows from its length,
    and a claim that opens a dialogue cites a turn that does not exist.
    """
    c = table(spark, sf_dir, "conversations")
    task = F.concat(F.lit("t"), F.col("conv_id").cast("string"))
    turn = lambda n: F.concat_ws(":", task, n.cast("string"))
    evidence = c.where(F.col("role") == "user").select(
        task.alias("task_id"), turn(F.col("turn")).alias("chunk_id"), F.sha2("text", 256).alias("content_hash")
    )
    n = F.length("text")
    claims = c.where(F.col("role") == "assistant").select(
        task.alias("task_id"),
        F.col("turn").alias("pos"),
        F.concat(F.lit("c"), F.col("turn").cast("string")).alias("claim_id"),
        F.col("text"),
        F.when(n < 200, "uncertain").when(n < 600, "inference").otherwise("supported").alias("epistemic_state"),
        F.when(n > 1500, F.array().cast("array<string>")).otherwise(F.array(turn(F.col("turn") - 1))).alias("refs"),
    )
    return evidence, claims


def latest_first(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")
