"""Which files enter the corpus and under which id; audits of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomtext.functions.exprs import strip
from fathomtext.functions.skew import lookup_join
from fathomtext.functions.stats import top_rows

# Default admission and naming rules.
EXCLUDED_DIRS = (
    "研究输出", "版本存档", "03_历史版本存档", "根级冗余",
    "_废弃_旧镜像", "research-expert-team", ".agents",
)
PROCESS_STEM = r"^(0\d[a-z]?|10)_"
PROCESS_WORD = "开题报告"
FINAL_WORD = "最终报告"
FINAL_STEM = "11_最终报告"
SUFFIX_WORDS = ("思维增量", "负知识")
CODE_STEM = r"^(M\d{1,2})_"
DIR_PRIORITY = {"02_主题研究报告": 0, "01_综合主报告": 1, "旗舰战略专题报告_完整备份_M01-M24": 2}
LARGE_FILE = 5_000_000


def path_parts(path: Column) -> Column:
    return F.split(path, r"[/\\]")


def file_name(path: Column) -> Column:
    return F.element_at(path_parts(path), -1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    parts = path_parts(path)
    return F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))


def parent_dirs(path: Column) -> Column:
    parts = path_parts(path)
    return F.slice(parts, 1, F.size(parts) - 1)


def exclusion_reason(
    path: Column, excluded_dirs: tuple[str, ...] = EXCLUDED_DIRS, process_stem: str = PROCESS_STEM,
    process_word: str = PROCESS_WORD, final_word: str = FINAL_WORD,
) -> Column:
    """Reason a path stays out of the corpus, null when it is admitted."""
    stem = stem_of(path)
    banned = F.arrays_overlap(parent_dirs(path), F.array(*[F.lit(d) for d in excluded_dirs]))
    return (
        F.when(banned, "EXCLUDED_DIR")
        .when(F.contains(stem, F.lit(process_word)) | stem.rlike(process_stem), "EXCLUDED_PROCESS")
        .when(~F.contains(stem, F.lit(final_word)), "EXCLUDED_NON_FINAL")
    )


def default_doc_id(path: Column, report_code: Column) -> Column:
    """Id from special stem words, the report code, the stem or the directory."""
    stem = stem_of(path)
    code = F.nullif(report_code, F.lit(""))
    base = F.coalesce(code, parent_name(path))
    from_stem = F.regexp_extract(stem, CODE_STEM, 1)
    chain = None
    for w in SUFFIX_WORDS:
        hit, value = F.contains(stem, F.lit(w)), F.concat(base, F.lit(f"__{w}"))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return (
        chain.when(code.isNotNull(), code)
        .when(from_stem != "", from_stem)
        .when(stem == FINAL_STEM, parent_name(path))
        .otherwise(stem)
    )


def canonical_key(path: Column, priorities: dict[str, int] = DIR_PRIORITY, final_word: str = FINAL_WORD) -> Column:
    """Struct that orders copies: final report, directory, path length, path."""
    names = F.create_map(*[F.lit(x) for kv in priorities.items() for x in kv])
    known = F.filter(path_parts(path), lambda p: p.isin(*priorities))
    return F.struct(
        F.when(F.contains(stem_of(path), F.lit(final_word)), 0).otherwise(1).alias("kind"),
        F.coalesce(F.element_at(names, F.get(known, F.lit(0))), F.lit(9)).alias("dir"),
        F.length(path).alias("n"),
        path.alias("path"),
    )


def assign_ids(
    candidates: DataFrame, catalog: DataFrame | None = None, key: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Final ids and duplicate exclusions.

    ``candidates(path, default_id, sha256)``; ``catalog(id, sha256, source_path)``.
    Returns ``assignments(path, document_id, disambiguated)`` and
    ``exclusions(path, reason, kept_path)``.

    Groups are reduced by ``min`` with a map-side combine, and rows meet their
    group's choice by path or through a join that spreads hot groups: a group of
    copies is never gathered.
    """
    rows = candidates.select("path", "default_id", "sha256", (key if key is not None else canonical_key(F.col("path"))).alias("k"))
    kept = rows.groupBy("default_id", "sha256").agg(F.min("k").alias("k")).select(
        "default_id", "sha256", "k", F.col("k.path").alias("path")
    )
    if catalog is not None:
        known = catalog.select(F.col("id").alias("default_id"), F.col("sha256").alias("_sha"), "source_path")
        kept = kept.join(known, "default_id", "left").withColumn(
            "indexed_as",
            F.when(
                (F.col("_sha") == F.col("sha256")) & (F.col("source_path") != F.col("path")), F.col("source_path")
            ),
        )
    else:
        kept = kept.withColumn("indexed_as", F.lit(None).cast("string"))
    entering = kept.where("indexed_as IS NULL")
    first = entering.groupBy("default_id").agg(F.min("k").alias("k")).select(
        F.col("k.path").alias("path"), F.lit(True).alias("is_first")
    )
    assignments = (
        entering.join(first, "path", "left")
        .withColumn("disambiguated", F.col("is_first").isNull())
        .select(
            "path",
            F.when(F.col("disambiguated"), F.concat_ws("__", "default_id", F.left("sha256", F.lit(8))))
            .otherwise(F.col("default_id"))
            .alias("document_id"),
            "disambiguated",
        )
    )
    chosen = kept.select(
        "default_id", "sha256", F.coalesce("indexed_as", F.col("path")).alias("kept_path"), "indexed_as",
        F.col("path").alias("chosen"),
    )
    copies = lookup_join(rows.select("path", "default_id", "sha256"), chosen, ["default_id", "sha256"], "path")
    exclusions = copies.where((F.col("path") != F.col("chosen")) | F.col("indexed_as").isNotNull()).select(
        "path", F.lit("EXCLUDED_DUPLICATE").alias("reason"), "kept_path"
    )
    return assignments, exclusions


def index_plan(changed: DataFrame, catalog: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Plan for new and modified files ``changed(path, report_code, sha256)``."""
    judged = changed.withColumn("reason", exclusion_reason(F.col("path")))
    refused = judged.where("reason IS NOT NULL").select("path", "reason", F.lit(None).cast("string").alias("kept_path"))
    admitted = judged.where("reason IS NULL").select(
        "path", default_doc_id(F.col("path"), F.col("report_code")).alias("default_id"), "sha256"
    )
    assignments, duplicates = assign_ids(admitted, catalog)
    return assignments, refused.unionByName(duplicates)


# --- audits -----------------------------------------------------------------------------


def exclusion_summary(exclusions: DataFrame) -> DataFrame:
    """Count and percentage per reason."""
    counts = exclusions.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    total = exclusions.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.select("reason", "n", F.round(F.col("n") * 100 / total, 2).alias("percent"))


def stratified_sample(rows: DataFrame, stratum: str, id_col: str, sizes: dict[str, int] | int, seed: int) -> DataFrame:
    """A fixed number of rows per stratum, drawn by a seeded hash of the id."""
    if isinstance(sizes, int):
        wanted, limit = F.lit(sizes), sizes
    else:
        wanted = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col(stratum)]
        limit = max(sizes.values())
    draw = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    picked = top_rows(rows.withColumn("_draw", draw), [stratum], [F.asc("_draw"), F.asc(id_col)], limit, "draw_rank")
    return picked.where(F.col("draw_rank") <= wanted).drop("_draw")


def duplicate_groups(files: DataFrame, hash_col: str = "sha256", path_col: str = "path") -> DataFrame:
    """Every file of a group of identical content with the size of its group, as a row each."""
    groups = files.groupBy(hash_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return lookup_join(files.select(hash_col, path_col), groups, [hash_col], path_col)


def corpus_profile(files: DataFrame) -> DataFrame:
    """Totals over ``files(path, content, size, doc_id)`` in one pass."""
    text_ok = F.is_valid_utf8(F.col("content").cast("string"))
    empty = text_ok & (strip(F.col("content").cast("string")) == "")
    usable = text_ok & ~empty
    per_id = (
        files.where(usable).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.count(F.lit(1)).alias("unique_ids"),
            F.count_if(F.col("n") > 1).alias("repeated_ids"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("files_with_repeated_ids"),
        )
    )
    totals = files.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.count_if(~text_ok).alias("bad_encoding"),
        F.count_if(empty).alias("empty"),
        F.count_if(F.col("size") > LARGE_FILE).alias("large"),
    )
    return totals.select(
        "*",
        *[per_id.select(c).scalar().alias(c) for c in ("unique_ids", "repeated_ids", "files_with_repeated_ids")],
    )


def files_per_directory(files: DataFrame, root: str = "") -> DataFrame:
    """File counts by first directory below the root, ``.`` for the root itself."""
    rel = F.regexp_replace(F.substring(F.col("path"), len(root) + 1, 1 << 20), r"^[/\\]+", "")
    parts = path_parts(rel)
    top = F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(".")
    return files.groupBy(top.alias("top_dir")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "top_dir")
