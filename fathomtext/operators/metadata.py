"""Document metadata: front matter, block-quote headers, canonical keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fathomtext.functions.exprs import (
    bind,
    empty_array,
    is_blank,
    keep_last_entries,
    lstrip_blanks,
    strip,
)

ENTRY = "struct<key:string,value:string>"

# Header keys found in documents and their canonical names.
CANONICAL_KEYS = {
    "专题代号": "report_code",
    "报告代号": "report_code",
    "所属领域": "domain",
    "研究方法": "research_method",
    "证据等级规范": "evidence_spec",
    "完成日期": "completed_at",
    "正文字数": "word_count",
    "首席技术官": "author",
    "作者": "author",
    "标题": "title",
    "状态": "status",
    "报告编号": "report_code",
    "报告 ID": "report_id",
    "report_id": "report_id",
    "domain": "domain",
    "completed_at": "completed_at",
    "status": "status",
    "title": "title",
}


def report_code_of(value: Column) -> Column:
    """Letter-digit prefix of a code, else the trimmed value; empty gives null."""
    trimmed = strip(value)
    prefix = F.regexp_extract(trimmed, r"^[A-Za-z]{1,6}\d+", 0)
    return F.when(value.isNull() | (value == ""), F.lit(None)).otherwise(
        F.when(prefix != "", prefix).otherwise(trimmed)
    )


def canonical_entries(entries: Column) -> Column:
    """Rename known keys, keep the others, reduce the report code to its prefix."""
    names = F.create_map(*[F.lit(x) for kv in CANONICAL_KEYS.items() for x in kv])

    def rename(e: Column) -> Column:
        return bind(
            F.element_at(names, strip(e["key"])),
            lambda canon: F.struct(
                F.coalesce(canon, strip(e["key"])).alias("key"),
                F.when(
                    F.coalesce(canon, strip(e["key"])) == "report_code",
                    F.coalesce(report_code_of(e["value"]), F.lit("")),
                )
                .when(canon.isNull(), e["value"])
                .otherwise(strip(F.coalesce(e["value"], F.lit(""))))
                .alias("value"),
            ),
        )

    return keep_last_entries(F.transform(keep_last_entries(entries), rename))


def _front_matter(lines: Column) -> Column:
    """Flat ``key: value`` lines between two ``---`` fences at the very top."""

    def inside(close: Column) -> Column:
        body = F.filter(
            F.slice(lines, 2, close - 2), lambda l: l.rlike(r"^[^\s#:][^:]*:(\s|$)")
        )

        def entry(l: Column) -> Column:
            raw = strip(F.regexp_extract(l, r"(?d)^[^:]+:(.*)$", 1))
            unquoted = F.regexp_replace(raw, r"""(?d)^(["'])(.*)\1$""", "$2")
            return F.struct(
                strip(F.regexp_extract(l, r"^([^:]+):", 1)).alias("key"),
                F.when(raw.isin("null", "~"), F.lit("")).otherwise(unquoted).alias("value"),
            )

        return F.transform(body, entry)

    fences = F.filter(
        F.transform(lines, lambda l, i: F.when(strip(l) == "---", i + 1)), lambda n: n.isNotNull()
    )
    opened = strip(F.get(lines, F.lit(0))) == "---"
    return F.when(
        (F.size(lines) > 0) & opened,
        bind(
            fences,
            lambda f: F.when(F.size(f) >= 2, inside(F.get(f, F.lit(1)))).otherwise(empty_array(ENTRY)),
        ),
    ).otherwise(empty_array(ENTRY))


def _quote_run(lines: Column) -> Column:
    """Entries of the ``>`` lines that open the given lines, blanks skipped."""

    def entries_of(line: Column) -> Column:
        content = strip(F.regexp_replace(lstrip_blanks(line), r"^>+", ""))
        parts = F.split(content, r"(?U)\s*[｜|]\s*")
        pattern = r"(?dU)\*\*(.+?)\*\*[：:]\s*(.*)$"

        def entry(p: Column) -> Column:
            value = strip(F.regexp_replace(strip(F.regexp_extract(p, pattern, 2)), r"\*+$", ""))
            return F.struct(
                strip(F.regexp_extract(p, pattern, 1)).alias("key"),
                strip(F.regexp_replace(value, r"^`+|`+$", "")).alias("value"),
            )

        return F.transform(F.filter(parts, lambda p: p.rlike(r"(?dU)\*\*(.+?)\*\*[：:]")), entry)

    def from_first(tail: Column) -> Column:
        stop = F.array_position(
            F.transform(tail, lambda l: ~F.startswith(lstrip_blanks(l), F.lit(">"))), F.lit(True)
        )
        return bind(
            stop,
            lambda n: F.flatten(
                F.transform(
                    F.when(n == 0, tail).otherwise(F.slice(tail, 1, (n - 1).cast("int"))), entries_of
                )
            ),
        )

    first = F.array_position(F.transform(lines, lambda l: ~is_blank(l)), F.lit(True))
    return bind(
        first,
        lambda n: F.when(n == 0, empty_array(ENTRY)).otherwise(
            from_first(F.slice(lines, n.cast("int"), F.size(lines)))
        ),
    )


def _after_title(lines: Column) -> Column:
    at = F.array_position(F.transform(lines, lambda l: F.startswith(l, F.lit("# "))), F.lit(True))
    return bind(
        at,
        lambda n: F.when(n == 0, empty_array(ENTRY)).otherwise(
            _quote_run(F.slice(lines, (n + 1).cast("int"), F.size(lines)))
        ),
    )


def metadata_entries(lines: Column) -> Column:
    """Front matter, else a quote header at the top, else one after the title."""
    found = bind(
        _front_matter(lines),
        lambda fm: F.when(F.size(fm) > 0, fm).otherwise(
            bind(
                _quote_run(lines),
                lambda top: F.when(F.size(top) > 0, top).otherwise(_after_title(lines)),
            )
        ),
    )
    return canonical_entries(found)
