"""Cutting sections into chunks, and the checks on the result.

Chunks are built inside the document row like the parse they come from, so the
running chunk number needs no window and the job no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fathomtext.functions.exprs import append, bind, clip, empty_array, lstrip_blanks, null_as, strip
from fathomtext.functions.stats import nearest_rank, top_rows
from fathomtext.functions.text import TermTrie, lexical_text, normal_form, plain_text
from fathomtext.operators.structure import BLOCK, evidence_levels

CHUNKER_VERSION = "1"

# Where a sentence ends.
SENTENCE_END = "(?<=[。；！？!?])"

# Section types that name the prose under them.
PROSE_TYPES = (
    "summary", "reference", "audit", "monitoring", "decision_tree", "comparison", "causal_chain",
)

GROUP = f"struct<kind:string,blocks:array<{BLOCK}>>"
PIECE = "struct<raw:string,start_line:int,end_line:int,content_type:string,oversized:boolean>"


@dataclass(frozen=True)
class ChunkLimits:
    """Default sizes in characters."""

    target: int = 900
    soft_min: int = 350
    soft_max: int = 1400
    hard_max: int = 2200
    overlap: int = 100
    formula_context: int = 400
    #: Whether a long paragraph is cut between sentences first.
    by_sentence: bool = True


def _last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def _without_last(items: Column) -> Column:
    return F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0)))


def split_long_paragraph(text: Column, limits: ChunkLimits = ChunkLimits()) -> Column:
    """Sentences packed up to the target; one endless sentence is cut hard.

    A piece of signs alone, of which no plain text is left, stays with the piece before it.
    """

    def step(acc: Column, sentence: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(sentence) > limits.target) & (acc["cur"] != "")
        out = F.when(full, append(acc["out"], acc["cur"])).otherwise(acc["out"])
        cur = F.when(full, sentence).otherwise(F.concat(acc["cur"], sentence))
        return bind(F.struct(out.alias("out"), cur.alias("cur")), cut)

    def cut(s: Column) -> Column:
        n = F.floor((F.length(s["cur"]) - 1) / limits.hard_max).cast("int")
        slices = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.substring(s["cur"], i * limits.hard_max + 1, F.lit(limits.hard_max)),
        )
        return F.when(F.length(s["cur"]) <= limits.hard_max, s).otherwise(
            F.struct(
                F.concat(s["out"], slices).alias("out"),
                F.substring(s["cur"], n * limits.hard_max + 1, F.length(s["cur"])).alias("cur"),
            )
        )

    start = F.struct(empty_array("string").alias("out"), F.lit("").alias("cur"))
    sentences = F.filter(F.split(text, SENTENCE_END), lambda x: strip(x) != "")
    pieces = F.aggregate(
        sentences,
        start,
        step,
        lambda acc: F.when(strip(acc["cur"]) != "", append(acc["out"], acc["cur"])).otherwise(acc["out"]),
    )

    def joined(out: Column, piece: Column) -> Column:
        unreadable = (F.size(out) > 0) & (plain_text(piece) == "")
        return F.when(unreadable, append(_without_last(out), F.concat(_last(out), piece))).otherwise(append(out, piece))

    return F.aggregate(pieces, empty_array("string"), joined)


def cut_paragraph(text: Column, limits: ChunkLimits = ChunkLimits()) -> Column:
    """Cuts of ``hard_max`` characters, wherever sentences end."""
    last = F.floor((F.length(text) - 1) / limits.hard_max).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(text, i * limits.hard_max + 1, F.lit(limits.hard_max))
    )


def _paragraphs(blocks: Column, limits: ChunkLimits) -> Column:
    split = split_long_paragraph if limits.by_sentence else cut_paragraph
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.when(
                F.length(b["text"]) > limits.hard_max,
                F.transform(split(b["text"], limits), lambda t: b.withField("text", t)),
            ).otherwise(F.array(b)),
        )
    )


def _piece(blocks: Column, content_type: Column, oversized: Column) -> Column:
    return F.struct(
        F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n").alias("raw"),
        F.array_min(F.transform(blocks, lambda b: b["start_line"])).alias("start_line"),
        F.array_max(F.transform(blocks, lambda b: b["end_line"])).alias("end_line"),
        content_type.alias("content_type"),
        oversized.alias("oversized"),
    ).cast(PIECE)


def _total_length(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0), lambda acc, b: acc + F.length(b["text"]))


def pack_prose(blocks: Column, content_type: Column, limits: ChunkLimits = ChunkLimits()) -> Column:
    """Greedy packing of paragraphs; a short last paragraph is repeated."""

    def step(acc: Column, p: Column) -> Column:
        n = F.length(p["text"])
        full = (
            (F.size(acc["cur"]) > 0)
            & (acc["len"] + n > limits.soft_max)
            & (acc["len"] >= limits.soft_min)
        )
        last = _last(acc["cur"])
        repeats = F.length(last["text"]) <= limits.overlap * 3
        return F.when(
            full,
            F.struct(
                append(acc["out"], _piece(acc["cur"], content_type, F.lit(False))).alias("out"),
                F.when(repeats, F.array(last, p)).otherwise(F.array(p)).alias("cur"),
                F.when(repeats, F.length(last["text"]) + n).otherwise(n).alias("len"),
            ),
        ).otherwise(
            F.struct(
                acc["out"].alias("out"),
                append(acc["cur"], p).alias("cur"),
                (acc["len"] + n).alias("len"),
            )
        )

    start = F.struct(
        empty_array(PIECE).alias("out"), empty_array(BLOCK).alias("cur"), F.lit(0).alias("len")
    )
    return F.aggregate(
        _paragraphs(blocks, limits),
        start,
        step,
        lambda acc: F.when(
            F.size(acc["cur"]) > 0,
            append(acc["out"], _piece(acc["cur"], content_type, acc["len"] > limits.hard_max)),
        ).otherwise(acc["out"]),
    )


def _groups(blocks: Column, limits: ChunkLimits) -> Column:
    """Runs of prose, and special blocks with the context a formula takes."""

    def group(kind: str, items: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), items.alias("blocks")).cast(GROUP)

    def flushed(out: Column, run: Column) -> Column:
        return F.when(F.size(run) > 0, append(out, group("prose", run))).otherwise(out)

    def state(out: Column, run: Column, skip: Column) -> Column:
        return F.struct(out.alias("out"), run.alias("run"), skip.alias("skip"))

    none = empty_array(BLOCK)

    def step(acc: Column, x: Column) -> Column:
        b, following = x["b"], x["following"]
        before = _last(acc["run"])
        takes_before = F.coalesce(F.length(before["text"]) <= limits.formula_context, F.lit(False))
        takes_after = F.coalesce(
            (following["block_type"] == "prose") & (F.length(following["text"]) <= limits.formula_context),
            F.lit(False),
        )
        formula = F.when(
            takes_before,
            state(
                append(flushed(acc["out"], _without_last(acc["run"])), group("special", F.array(before, b))),
                none,
                F.lit(False),
            ),
        ).otherwise(
            state(
                append(
                    flushed(acc["out"], acc["run"]),
                    group("special", F.when(takes_after, F.array(b, following)).otherwise(F.array(b))),
                ),
                none,
                takes_after,
            )
        )
        return (
            F.when(acc["skip"], state(acc["out"], acc["run"], F.lit(False)))
            .when(b["block_type"] == "prose", state(acc["out"], append(acc["run"], b), F.lit(False)))
            .when(b["block_type"] == "formula", formula)
            .otherwise(
                state(
                    append(flushed(acc["out"], acc["run"]), group("special", F.array(b))),
                    none,
                    F.lit(False),
                )
            )
        )

    paired = F.transform(
        blocks,
        lambda b, i: F.struct(b.alias("b"), F.get(blocks, i + 1).alias("following")),
    )
    return F.aggregate(
        paired,
        state(empty_array(GROUP), none, F.lit(False)),
        step,
        lambda acc: flushed(acc["out"], acc["run"]),
    )


def _special_type(block: Column, section_type: Column) -> Column:
    kind = block["block_type"]
    return (
        F.when(kind.isin("ascii_diagram", "mermaid"), "causal_chain")
        .when((kind == "table") & section_type.isin("monitoring", "comparison"), section_type)
        .otherwise(kind)
    )


def _section_pieces(section: Column, limits: ChunkLimits) -> Column:
    prose_type = F.when(section["section_type"].isin(*PROSE_TYPES), section["section_type"]).otherwise("prose")
    quote_only = lambda b: (b["block_type"] == "prose") & F.forall(
        F.split(b["text"], "\n"), lambda l: (strip(l) == "") | F.startswith(lstrip_blanks(l), F.lit(">"))
    )
    body = F.when(section["ordinal"] == 0, F.filter(section["blocks"], lambda b: ~quote_only(b))).otherwise(
        section["blocks"]
    )

    def cut(g: Column) -> Column:
        lead = F.get(F.filter(g["blocks"], lambda b: b["block_type"] != "prose"), F.lit(0))
        return F.when(g["kind"] == "prose", pack_prose(g["blocks"], prose_type, limits)).otherwise(
            F.array(
                _piece(
                    g["blocks"],
                    _special_type(lead, section["section_type"]),
                    _total_length(g["blocks"]) > limits.hard_max,
                )
            )
        )

    return F.flatten(F.transform(bind(body, lambda bs: _groups(bs, limits)), cut))


def embedding_text(
    title: Column, domain: Column, path: Column, content_type: Column, level: Column, text: Column
) -> Column:
    """What is embedded for a chunk: the text under its document context."""
    return F.concat(
        F.lit("Document: "), F.coalesce(title, F.lit("")),
        F.lit("\nDomain: "), F.coalesce(F.nullif(domain, F.lit("")), F.lit("unknown")),
        F.lit("\nSection: "), F.coalesce(F.nullif(path, F.lit("")), F.lit("(root)")),
        F.lit("\nContent Type: "), content_type,
        F.lit("\nEvidence: "),
        F.when(level.isNull(), "unmarked").otherwise(F.concat(F.lit("L"), level.cast("string"))),
        F.lit("\n\n"), text,
    )


def chunk_table(
    parsed: DataFrame,
    id_col: str = "document_id",
    limits: ChunkLimits = ChunkLimits(),
    domain_terms: Column | TermTrie | None = None,
) -> DataFrame:
    """Chunks of parsed documents, one row each."""
    pieces = F.flatten(
        F.transform(
            F.col("sections"),
            lambda s: F.transform(
                _section_pieces(s, limits),
                lambda p: F.struct(
                    s["section_id"].alias("section_id"),
                    F.array_join(s["heading_path"], " > ").alias("heading_path"),
                    s["evidence_levels"].alias("section_levels"),
                    p.alias("piece"),
                ),
            ),
        )
    )
    exploded = parsed.select(
        F.col(id_col).cast("string").alias("document_id"),
        F.coalesce(F.element_at("metadata", F.lit("title")), F.col("title")).alias("title"),
        F.coalesce(F.element_at("metadata", F.lit("domain")), F.lit("")).alias("domain"),
        F.posexplode(pieces).alias("pos", "c"),
    )
    raw = F.col("c.piece.raw")
    own = evidence_levels(raw)
    shaped = exploded.select(
        "document_id",
        "title",
        "domain",
        F.col("c.section_id").alias("section_id"),
        (F.col("pos") + 1).alias("ordinal"),
        F.col("c.heading_path").alias("heading_path"),
        F.col("c.piece.content_type").alias("content_type"),
        raw.alias("raw_markdown"),
        plain_text(raw).alias("plain_text"),
        F.when(F.size(own) > 0, own).otherwise(F.col("c.section_levels")).alias("evidence_levels"),
        F.col("c.piece.start_line").alias("start_line"),
        F.col("c.piece.end_line").alias("end_line"),
        F.col("c.piece.oversized").alias("oversized"),
        F.sha2(raw, 256).alias("content_hash"),
    ).withColumn("evidence_level", F.array_min("evidence_levels")).withColumn("normal", normal_form(F.col("plain_text")))
    return shaped.select(
        F.format_string("%s:%s:%04d", "document_id", "section_id", "ordinal").alias("id"),
        "document_id",
        "section_id",
        "ordinal",
        "heading_path",
        "content_type",
        "raw_markdown",
        "plain_text",
        embedding_text(
            F.col("title"), F.col("domain"), F.col("heading_path"), F.col("content_type"),
            F.col("evidence_level"), F.col("plain_text"),
        ).alias("embedding_text"),
        lexical_text(F.col("normal"), domain_terms).alias("lexical_text"),
        "evidence_level",
        F.when(F.size("evidence_levels") > 0, F.col("evidence_levels")).alias("evidence_levels"),
        "start_line",
        "end_line",
        "oversized",
        "content_hash",
    )


def section_embedding_rows(parsed: DataFrame, id_col: str = "document_id", summary_chars: int = 500) -> DataFrame:
    """One row per section except the root: heading, path and first prose."""
    s = F.col("s")
    first_prose = F.get(F.filter(s["blocks"], lambda b: b["block_type"] == "prose"), F.lit(0))["text"]
    return (
        parsed.select(
            F.col(id_col).cast("string").alias("document_id"),
            F.coalesce(F.element_at("metadata", F.lit("title")), F.col("title")).alias("title"),
            F.coalesce(F.element_at("metadata", F.lit("domain")), F.lit("")).alias("domain"),
            F.explode("sections").alias("s"),
        )
        .where(s["ordinal"] > 0)
        .select(
            "document_id",
            s["section_id"].alias("section_id"),
            s["heading"].alias("heading"),
            s["section_type"].alias("section_type"),
            F.array_min(s["evidence_levels"]).alias("evidence_level"),
            F.concat(
                F.lit("Document: "), F.col("title"),
                F.lit("\nDomain: "), F.col("domain"),
                F.lit("\nSection Path: "), F.array_join(s["heading_path"], " > "),
                F.lit("\nHeading: "), s["heading"],
                F.lit("\n\n"), clip(F.coalesce(first_prose, F.lit("")), summary_chars),
            ).alias("embedding_text"),
        )
    )


# --- checks -----------------------------------------------------------------------


def chunk_stats(chunks: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Counts and nearest-rank length percentiles."""
    groups = group_cols or []
    sized = chunks.select(
        *groups, F.length("plain_text").alias("n_chars"), F.col("oversized").cast("int").alias("oversized")
    )
    base = sized.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.min("n_chars").alias("min"),
        F.max("n_chars").alias("max"),
        F.round(F.avg("n_chars"), 1).alias("mean"),
        F.sum("oversized").alias("oversized"),
    )
    ranks = nearest_rank(
        sized, groups, "n_chars", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    )
    if not groups:
        key = "_all"
        return base.withColumn(key, F.lit(1)).join(ranks.withColumn(key, F.lit(1)), key).drop(key)
    return base.join(ranks, groups)


def content_type_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))


def chunk_gates(chunks: DataFrame, sections: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Per document: the six counts that must be zero, and broken diagrams.

    ``documents`` carries ``document_id`` and ``n_lines``.  The range joins are
    equi-joins on the document with the containment as residual condition.
    """
    c = chunks.select("document_id", "section_id", "id", "start_line", "end_line", "plain_text").alias("c")
    special = blocks.where(F.col("block_type").isin("table", "formula", "mermaid", "ascii_diagram")).alias("b")
    covered = (
        (F.col("c.document_id") == F.col("b.document_id"))
        & (F.col("c.start_line") <= F.col("b.start_line"))
        & (F.col("c.end_line") >= F.col("b.end_line"))
    )
    broken = special.join(c, covered, "left_anti").groupBy("document_id").agg(
        F.count_if(F.col("block_type") == "table").alias("broken_table"),
        F.count_if(F.col("block_type") == "formula").alias("broken_formula"),
        F.count_if(F.col("block_type").isin("mermaid", "ascii_diagram")).alias("broken_diagram"),
    )
    s = sections.select("document_id", "section_id", "start_line").alias("s")
    foreign = (
        (F.col("c.document_id") == F.col("s.document_id"))
        & F.col("s.start_line").between(F.col("c.start_line"), F.col("c.end_line"))
        & (F.col("s.section_id") != F.col("c.section_id"))
    )
    crossing = c.join(s, foreign, "left_semi").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("cross_section")
    )
    repeated = (
        c.groupBy("document_id", "id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("document_id").agg(F.sum(F.col("n") - 1).alias("duplicate_chunk_id"))
    )
    lines = documents.select("document_id", "n_lines")
    own = c.join(lines, "document_id").groupBy("document_id").agg(
        F.count_if(
            (F.col("start_line") < 1)
            | (F.col("end_line") > F.col("n_lines"))
            | (F.col("start_line") > F.col("end_line"))
        ).alias("invalid_line_range"),
        F.count_if(strip(F.col("plain_text")) == "").alias("empty_chunk"),
    )
    gates = ["broken_table", "broken_formula", "cross_section", "invalid_line_range", "duplicate_chunk_id", "empty_chunk"]
    out = lines.select("document_id")
    for part in (broken, crossing, repeated, own):
        out = out.join(part, "document_id", "left")
    out = out.na.fill(0)
    passed = F.lit(True)
    for g in gates:
        passed = passed & (F.col(g) == 0)
    return out.select("document_id", *gates, "broken_diagram", passed.alias("gate_passed"))


def oversized_count(chunks: DataFrame, hard_max: int = ChunkLimits.hard_max) -> DataFrame:
    return chunks.where(F.length("plain_text") > hard_max).agg(F.count(F.lit(1)).alias("oversized_chunks"))


def chunk_samples(chunks: DataFrame, n: int = 3) -> DataFrame:
    """First chunks of each content type, for review."""
    return top_rows(chunks, ["content_type"], [F.asc("document_id"), F.asc("ordinal")], n, "sample_rank")


def recheck(stored: DataFrame, parsed: DataFrame, columns: tuple[str, ...] = ("id", "start_line", "end_line", "content_hash")) -> DataFrame:
    """Chunks that a fresh run over ``parsed`` gives differently than stored.

    ``side`` tells whether a row is only in the store or only in the new run.
    """
    documents = parsed.select(F.col("document_id").cast("string").alias("document_id"))
    old = stored.join(documents, "document_id", "left_semi").select(*columns)
    new = chunk_table(parsed).select(*columns)
    return old.exceptAll(new).withColumn("side", F.lit("stored")).unionByName(
        new.exceptAll(old).withColumn("side", F.lit("fresh"))
    )
