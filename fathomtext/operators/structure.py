"""Heading tree and blocks of Markdown-like documents.

A document is one row, and so is its parse: lines, headings, sections and
blocks are arrays inside the row, built with higher-order functions.  Nothing
is shuffled, and the memory of a task is bounded by its largest document.
``sections`` and ``blocks`` explode the arrays into tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomtext.functions.exprs import append, bind, empty_array, lstrip_blanks, null_as, strip
from fathomtext.operators.metadata import metadata_entries, report_code_of

# Line and heading shapes.
LINE_END = "\r\n|[\n\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
HEADING = r"(?dU)^(#{1,6})\s+(.*?)\s*#*\s*$"
FENCE = r"(?dU)^\s*(`{3,}|~{3,})\s*([\w+-]*)\s*$"
TABLE_ROW = r"(?dU)^\s*\|.*\|\s*$"
FORMULA_FENCE = r"(?dU)^\s*\$\$\s*$"
RULE = r"(?dU)^\s*(-{3,}|\*{3,}|_{3,})\s*$"
MERMAID_HINT = r"(?i)(graph|flowchart|sequenceDiagram|erDiagram|gantt|stateDiagram)"
BOX_CHARACTERS = "[─│┌┐└┘├┤┬┴┼═║╔╗╚╝▲▼►◀]"
HTML_TAG = r"</?[a-zA-Z][^>]*/?>"
CHAPTER = r"(?U)^第\s*([0-9一二三四五六七八九十]+)\s*章"
DOTTED_NUMBER = r"(?U)^(\d+(?:\.\d+)+)"
BARE_NUMBER = r"(?U)^(\d+)$"
PAREN_NUMBER = r"(?U)^[（(](\d+)[）)]"
EVIDENCE_MARK = r"\[L([1-5])\]"

# Section types by heading keyword, first match wins.
SECTION_TYPES = [
    ("summary", ["执行摘要", "executive summary"]),
    ("toc", ["目录", "table of contents"]),
    ("reference", ["参考文献", "references", "资料来源"]),
    ("audit", ["审计", "验收核查"]),
    ("monitoring", ["监测信号看板", "监测指标", "监测看板"]),
    ("decision_tree", ["决策树"]),
    ("comparison", ["对比", "差异", "vs"]),
    ("causal_chain", ["因果"]),
]
INHERITED_TYPES = ("reference", "audit")

# Chinese numerals.
DIGITS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100}

BLOCK = "struct<block_type:string,start_line:int,end_line:int,text:string,lang:string>"
SECTION = (
    "struct<ordinal:int,level:int,heading:string,heading_path:array<string>,section_id:string,"
    "parent_id:string,start_line:int,end_line:int,own_type:string,section_type:string>"
)
NODE = "struct<ordinal:int,section_id:string,heading_path:array<string>,section_type:string>"
SPAN = "struct<block_type:string,start_line:int,end_line:int,lang:string>"


# --- lines --------------------------------------------------------------------


def split_lines(text: Column) -> Column:
    """Array of lines; one empty piece after a final line end is dropped."""
    return bind(
        F.split(text, LINE_END),
        lambda ls: F.when(
            F.element_at(ls, -1) == "", F.slice(ls, 1, F.size(ls) - 1)
        ).otherwise(ls),
    )


def line_table(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """One row per line with its 1-based number."""
    return docs.select(
        id_col, F.posexplode(split_lines(F.col(text_col))).alias("pos", "line")
    ).select(id_col, (F.col("pos") + 1).alias("line_no"), "line")


# --- numerals, types, evidence marks ------------------------------------------


def numeral_value(s: Column) -> Column:
    """Value of a decimal (of any length) or Chinese numeral as digits; anything unknown gives 0."""
    digits = F.create_map(*[F.lit(x) for kv in DIGITS.items() for x in kv])
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])

    def step(acc: Column, ch: Column) -> Column:
        unit, digit = F.element_at(units, ch), F.element_at(digits, ch)
        return F.struct(
            F.when(
                unit.isNotNull(),
                acc["total"] + F.greatest(acc["num"], F.lit(1)) * unit,
            ).otherwise(acc["total"]).alias("total"),
            F.when(unit.isNotNull(), F.lit(0))
            .otherwise(F.coalesce(digit, acc["num"])).alias("num"),
            (acc["ok"] & (unit.isNotNull() | digit.isNotNull() | (ch == "零"))).alias("ok"),
        )

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("num"), F.lit(True).alias("ok"))
    folded = F.aggregate(
        F.filter(F.split(strip(s), ""), lambda ch: ch != ""),
        start,
        step,
        lambda acc: F.when(acc["ok"], acc["total"] + acc["num"]).otherwise(0),
    )
    return F.when(s.rlike(r"^[0-9]+$"), F.coalesce(F.nullif(F.ltrim(s, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(folded.cast("string"))


def section_type_of(heading: Column) -> Column:
    lowered = F.lower(heading)
    chain = None
    for name, words in SECTION_TYPES:
        hit = None
        for w in words:
            test = F.contains(lowered, F.lit(w))
            hit = test if hit is None else hit | test
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("body")


def evidence_levels(text: Column) -> Column:
    """Distinct evidence levels in order of first appearance."""
    return F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(EVIDENCE_MARK), 1), lambda x: x.cast("int"))
    )


def levels_of_lines(lines: Column) -> Column:
    return F.array_sort(evidence_levels(F.array_join(lines, "\n")))


# --- heading tree ---------------------------------------------------------------


def numbered_section_id(heading: Column, parent_id: Column, position: Column) -> Column:
    """Section id from the numbering in the heading; ``position`` counts from 1."""
    chapter = F.regexp_extract(heading, CHAPTER, 1)
    dotted = F.regexp_extract(heading, DOTTED_NUMBER, 1)
    bare = F.regexp_extract(heading, BARE_NUMBER, 1)
    paren = F.regexp_extract(heading, PAREN_NUMBER, 1)
    has_parent = parent_id.isNotNull()
    dashed = F.replace(dotted, F.lit("."), F.lit("-"))
    own_chapter = has_parent & (F.concat(F.lit("ch"), F.substring_index(dotted, ".", 1)) == parent_id)
    below = F.concat(parent_id, F.regexp_replace(dashed, r"^[^-]+", ""))
    return (
        F.when(chapter != "", F.concat(F.lit("ch"), numeral_value(chapter)))
        .when((dotted != "") & own_chapter, below)
        .when(dotted != "", F.concat(F.lit("ch"), dashed))
        .when((bare != "") & ~has_parent, F.concat(F.lit("ch"), bare))
        .when((paren != "") & has_parent, F.concat(parent_id, F.lit(":o"), paren))
        .when(has_parent, F.concat(parent_id, F.lit(":o"), position.cast("string")))
        .otherwise(F.concat(F.lit("top"), position.cast("string")))
    )


def _headings(lines: Column) -> Column:
    def read(line: Column, i: Column) -> Column:
        marks = F.length(F.regexp_extract(line, HEADING, 1))
        return F.when(
            F.startswith(line, F.lit("#")) & line.rlike(HEADING) & (marks <= 4),
            F.struct(
                (i + 1).alias("line"),
                marks.alias("level"),
                strip(F.regexp_extract(line, HEADING, 2)).alias("heading"),
            ),
        )

    return F.filter(F.transform(lines, read), lambda h: h.isNotNull())


def position_section_id(parent_id: Column, position: Column) -> Column:
    """Section id from the place in the tree alone; ``position`` counts from 1."""
    place = position.cast("string")
    return F.coalesce(F.concat(parent_id, F.lit(":o"), place), F.concat(F.lit("top"), place))


def _tree(headings: Column, n_lines: Column, numbered: bool = True) -> Column:
    """Sections of one document, folded over its headings in order."""
    title = F.get(headings, F.lit(0))["heading"]

    def step(acc: Column, h: Column) -> Column:
        parent = F.array_max(
            F.array(*[F.when(h["level"] > k, acc[f"open{k}"]) for k in (1, 2, 3)])
        )
        return bind(parent, lambda p: with_parent(acc, h, p))

    def with_parent(acc: Column, h: Column, p: Column) -> Column:
        position = F.size(acc["out"]) + 1
        wanted = (
            numbered_section_id(h["heading"], p["section_id"], position)
            if numbered
            else position_section_id(p["section_id"], position)
        )
        return bind(wanted, lambda w: bind(free_id(acc["used"], w), lambda sid: extend(acc, h, p, sid)))

    def free_id(used: Column, wanted: Column) -> Column:
        suffixed = F.transform(
            F.sequence(F.lit(1), F.size(used) + 1),
            lambda n: F.concat(wanted, F.lit(":x"), n.cast("string")),
        )
        return F.when(
            F.array_contains(used, wanted),
            F.get(F.filter(suffixed, lambda s: ~F.array_contains(used, s)), F.lit(0)),
        ).otherwise(wanted)

    def extend(acc: Column, h: Column, p: Column, sid: Column) -> Column:
        own = section_type_of(h["heading"])
        kind = F.when(
            (own == "body") & p["section_type"].isin(*INHERITED_TYPES), p["section_type"]
        ).otherwise(own)
        path = append(F.coalesce(p["heading_path"], empty_array("string")), h["heading"])
        node = F.struct(
            F.size(acc["out"]).alias("ordinal"),
            sid.alias("section_id"),
            path.alias("heading_path"),
            kind.alias("section_type"),
        ).cast(NODE)
        return bind(node, lambda nd: F.struct(
            append(acc["used"], sid).alias("used"),
            *[F.when(h["level"] == k, nd).otherwise(acc[f"open{k}"]).alias(f"open{k}") for k in (1, 2, 3)],
            append(
                acc["out"],
                F.struct(
                    nd["ordinal"].alias("ordinal"),
                    h["level"].alias("level"),
                    h["heading"].alias("heading"),
                    nd["heading_path"].alias("heading_path"),
                    sid.alias("section_id"),
                    p["section_id"].alias("parent_id"),
                    h["line"].alias("start_line"),
                    (F.coalesce(
                        F.get(headings, F.size(acc["out"]) + 1)["line"] - 1, n_lines
                    )).alias("end_line"),
                    own.alias("own_type"),
                    nd["section_type"].alias("section_type"),
                ).cast(SECTION),
            ).alias("out"),
        ))

    start = F.struct(
        empty_array("string").alias("used"),
        *[null_as(NODE).alias(f"open{k}") for k in (1, 2, 3)],
        empty_array(SECTION).alias("out"),
    )

    def rooted(s: Column) -> Column:
        chain = s["heading_path"]
        return s.withField(
            "heading_path",
            F.when(
                (s["ordinal"] > 0) & (F.get(chain, F.lit(0)) != title),
                F.concat(F.array(title), chain),
            ).otherwise(chain),
        )

    return F.transform(F.aggregate(headings, start, step, lambda acc: acc["out"]), rooted)


def _single_section(n_lines: Column) -> Column:
    return F.array(
        F.struct(
            F.lit(0).alias("ordinal"),
            F.lit(1).alias("level"),
            F.lit("(untitled)").alias("heading"),
            F.array(F.lit("(untitled)")).alias("heading_path"),
            F.lit("top1").alias("section_id"),
            null_as("string").alias("parent_id"),
            F.lit(1).alias("start_line"),
            n_lines.alias("end_line"),
            F.lit("body").alias("own_type"),
            F.lit("body").alias("section_type"),
        ).cast(SECTION)
    )


# --- blocks ---------------------------------------------------------------------


def _line_kind(line: Column) -> Column:
    """Kind of a line plus the fence it may open, as a small struct."""
    first = F.substring(lstrip_blanks(line), 1, 1)
    fence = F.regexp_extract(line, FENCE, 1)
    kind = (
        F.when(strip(line) == "", "blank")
        .when(first.isin("-", "*", "_") & line.rlike(RULE), "rule")
        .when(first.isin("`", "~") & line.rlike(FENCE), "fence")
        .when((first == "|") & line.rlike(TABLE_ROW), "table")
        .when((first == "$") & line.rlike(FORMULA_FENCE), "formula")
        .otherwise("text")
    )
    return bind(
        kind,
        lambda k: F.struct(
            k.alias("kind"),
            F.when(k == "fence", F.substring(fence, 1, 1)).alias("mark"),
            F.when(k == "fence", F.length(fence)).alias("width"),
            F.when(k == "fence", F.regexp_extract(line, FENCE, 2)).alias("lang"),
        ),
    )


def _spans(lines: Column, first: Column, last: Column) -> Column:
    """Block spans of the body lines ``first..last``, folded line by line."""

    def state(mode, start, mark, width, lang, out) -> Column:
        return F.struct(
            mode.alias("mode"), start.alias("start"), mark.alias("mark"),
            width.alias("width"), lang.alias("lang"), out.alias("out"),
        )

    none_s, none_i = null_as("string"), null_as("int")

    def span(kind: Column, start: Column, end: Column, lang: Column) -> Column:
        return F.struct(
            kind.alias("block_type"), start.alias("start_line"), end.alias("end_line"), lang.alias("lang")
        ).cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        k, n = x["kind"], x["no"]
        closed = F.when(
            acc["mode"].isin("prose", "table"),
            append(acc["out"], span(acc["mode"], acc["start"], n - 1, none_s)),
        ).otherwise(acc["out"])
        ended = state(
            F.lit(""), none_i, none_s, none_i, none_s,
            append(acc["out"], span(acc["mode"], acc["start"], n, acc["lang"])),
        )
        closes_fence = (
            (k == "fence") & (x["lang"] == "") & (x["mark"] == acc["mark"]) & (x["width"] >= acc["width"])
        )
        return (
            F.when(acc["mode"] == "code", F.when(closes_fence, ended).otherwise(acc))
            .when(acc["mode"] == "formula", F.when(k == "formula", ended).otherwise(acc))
            .when(
                (k == "text") & (acc["mode"] == "prose") | (k == "table") & (acc["mode"] == "table"), acc
            )
            .when(k == "text", state(F.lit("prose"), n, none_s, none_i, none_s, closed))
            .when(k == "table", state(F.lit("table"), n, none_s, none_i, none_s, closed))
            .when(k == "formula", state(F.lit("formula"), n, none_s, none_i, none_s, closed))
            .when(
                k == "fence",
                state(F.lit("code"), n, x["mark"], x["width"], F.nullif(x["lang"], F.lit("")), closed),
            )
            .otherwise(state(F.lit(""), none_i, none_s, none_i, none_s, closed))
        )

    start = state(
        F.lit(""), none_i, none_s, none_i, none_s, empty_array(SPAN)
    )
    kinds = F.transform(
        F.slice(lines, first, last - first + 1),
        lambda l, i: bind(
            _line_kind(l),
            lambda k: F.struct(
                k["kind"].alias("kind"), (first + i).alias("no"),
                k["mark"].alias("mark"), k["width"].alias("width"), k["lang"].alias("lang"),
            ),
        ),
    )

    def finish(acc: Column) -> Column:
        return F.when(acc["mode"] == "", acc["out"]).otherwise(
            append(acc["out"], span(acc["mode"], acc["start"], last, acc["lang"]))
        )

    return F.when(
        last >= first, F.aggregate(kinds, start, step, finish)
    ).otherwise(empty_array(SPAN))


def _blocks(lines: Column, first: Column, last: Column) -> Column:
    def fill(s: Column) -> Column:
        raw = F.array_join(F.slice(lines, s["start_line"], s["end_line"] - s["start_line"] + 1), "\n")

        def typed(t: Column) -> Column:
            body = F.regexp_replace(F.regexp_replace(t, r"\A[^\n]*\n?", ""), r"\n?[ \t]*(`{3,}|~{3,})[ \t]*\z", "")
            kind = (
                F.when(s["block_type"] != "code", s["block_type"])
                .when(F.lower(s["lang"]) == "mermaid", "mermaid")
                .when(s["lang"].isNull() & body.rlike(MERMAID_HINT), "mermaid")
                .when(s["lang"].isNull() & body.rlike(BOX_CHARACTERS), "ascii_diagram")
                .otherwise("code")
            )
            return F.struct(
                kind.alias("block_type"),
                s["start_line"].alias("start_line"),
                s["end_line"].alias("end_line"),
                F.when(s["block_type"] == "prose", strip(t)).otherwise(t).alias("text"),
                s["lang"].alias("lang"),
            ).cast(BLOCK)

        return bind(raw, typed)

    def holds_content(b: Column) -> Column:
        return (b["block_type"] != "prose") | (strip(F.regexp_replace(b["text"], HTML_TAG, "")) != "")

    return F.filter(F.transform(_spans(lines, first, last), fill), holds_content)


# --- public ---------------------------------------------------------------------


def parsed_column(text: Column, numbered: bool = True) -> Column:
    """The whole parse of one text as a struct column."""

    def of_lines(lines: Column) -> Column:
        return bind(_headings(lines), lambda hs: of_headings(lines, hs))

    def of_headings(lines: Column, hs: Column) -> Column:
        n = F.size(lines)
        tree = F.when(F.size(hs) > 0, _tree(hs, n, numbered)).otherwise(_single_section(n))
        untitled = F.size(hs) == 0

        def complete(s: Column) -> Column:
            body_from = F.when(untitled, F.lit(1)).otherwise(s["start_line"] + 1)
            own_lines = F.slice(lines, s["start_line"], F.greatest(s["end_line"] - s["start_line"] + 1, F.lit(0)))
            return bind(
                body_from,
                lambda first: s.withField("evidence_levels", levels_of_lines(own_lines)).withField(
                    "blocks", _blocks(lines, first, s["end_line"])
                ),
            )

        title = F.coalesce(F.get(hs, F.lit(0))["heading"], F.lit(""))
        entries = metadata_entries(lines)
        return F.struct(
            title.alias("title"),
            F.map_from_entries(
                bind(
                    entries,
                    lambda es: F.when(
                        untitled | F.exists(es, lambda e: e["key"] == "title"), es
                    ).otherwise(
                        append(es, F.struct(F.lit("title").alias("key"), title.alias("value")))
                    ),
                )
            ).alias("metadata"),
            n.alias("n_lines"),
            F.transform(tree, complete).alias("sections"),
        )

    return bind(split_lines(text), of_lines)


def parse_documents(docs: DataFrame, text_col: str = "text", numbered: bool = True) -> DataFrame:
    """Add ``title``, ``metadata``, ``n_lines`` and the nested ``sections``.

    Sections are named by the numbers in their headings; without ``numbered``, where headings are plain
    lines that may begin with any digits, by their place.  The parse is passed through a generator so that
    later projections read its fields instead of repeating it.
    """
    out = docs.withColumn("_parsed", F.explode(F.array(parsed_column(F.col(text_col), numbered))))
    return out.select(
        *docs.columns,
        F.col("_parsed.title").alias("title"),
        F.col("_parsed.metadata").alias("metadata"),
        F.col("_parsed.n_lines").alias("n_lines"),
        F.col("_parsed.sections").alias("sections"),
    )


def report_code(metadata: Column) -> Column:
    return report_code_of(F.element_at(metadata, F.lit("report_code")))


def sections_table(parsed: DataFrame, id_col: str = "document_id") -> DataFrame:
    """One row per section, keyed ``{document}:{section}``."""
    s = F.col("s")
    return parsed.select(F.col(id_col), F.explode("sections").alias("s")).select(
        F.concat_ws(":", F.col(id_col), s["section_id"]).alias("id"),
        F.col(id_col).alias("document_id"),
        s["section_id"].alias("section_id"),
        F.when(
            s["parent_id"].isNotNull(), F.concat_ws(":", F.col(id_col), s["parent_id"])
        ).alias("parent_section_id"),
        s["level"].alias("level"),
        s["heading"].alias("heading"),
        F.array_join(s["heading_path"], " > ").alias("heading_path"),
        s["own_type"].alias("own_type"),
        s["section_type"].alias("section_type"),
        s["ordinal"].alias("ordinal"),
        s["start_line"].alias("start_line"),
        s["end_line"].alias("end_line"),
        s["evidence_levels"].alias("evidence_levels"),
    )


def blocks_table(parsed: DataFrame, id_col: str = "document_id") -> DataFrame:
    """One row per block."""
    return (
        parsed.select(F.col(id_col).alias("document_id"), F.explode("sections").alias("s"))
        .select("document_id", F.col("s.section_id").alias("section_id"), F.posexplode("s.blocks").alias("pos", "b"))
        .select("document_id", "section_id", "pos", "b.*")
    )


def duplicate_section_ids(sections: DataFrame) -> DataFrame:
    """Warnings: section ids that occur more than once in a document."""
    return (
        sections.groupBy("document_id", "section_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )
