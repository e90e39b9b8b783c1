"""Heading tree, ids, ranges, blocks and metadata on written-out documents."""

from pyspark.sql import functions as F

from fathomtext.operators.structure import (
    blocks_table, duplicate_section_ids, numeral_value, parse_documents, sections_table,
)

NESTED = (
    "# Manual\n\nintro\n\n## 1.1 First\n\ntext a\n\n### (1) One\n\nb\n\n### (2) Two\n\nc\n\n"
    "## 1.2 Second\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n# 第 2 章 Next\n\nd\n"
)
MIXED = (
    "---\nreport_code: Q12_long\ndomain: \"power\"\n---\n# Top\n\n## Maths\n\nsome words\n\n$$\nE = m\n$$\n\n"
    "## Code\n\n```python\nprint(1)\n```\n\n```mermaid\ngraph TD; A-->B;\n```\n\n```\n┌──┐\n```\n<a id=\"x\"></a>\n\n***\nlast\n"
)
QUOTED = (
    "# T\n\n> **专题代号**：`Q05_xx` ｜ **完成日期**：2026-08-27\n> **note**: bar**\n\n"
    "## 第一章 a\n## 第十一章 b\n## 第十一章 c\nx [L2] [L1] [L2]\n## 参考文献\n### plain\nx"
)


def rows(spark):
    docs = [("n", NESTED), ("m", MIXED), ("q", QUOTED), ("flat", "no head\n\nx"), ("empty", "")]
    return parse_documents(spark.createDataFrame(docs, "document_id string, text string")).persist()


def test_tree_blocks_and_metadata(spark):
    parsed = rows(spark)
    s = {(r.document_id, r.heading, r.start_line): r for r in sections_table(parsed).collect()}
    n = {h: r for (d, h, _), r in s.items() if d == "n"}
    assert {h: r.section_id for h, r in n.items()} == {
        "Manual": "top1", "1.1 First": "ch1-1", "(1) One": "ch1-1:o1", "(2) Two": "ch1-1:o2",
        "1.2 Second": "ch1-2", "第 2 章 Next": "ch2",
    }
    assert n["(1) One"].heading_path == "Manual > 1.1 First > (1) One"
    assert n["(1) One"].parent_section_id == "n:ch1-1"
    assert (n["1.2 Second"].start_line, n["1.2 Second"].end_line) == (17, 22)
    q = sorted((r.ordinal, r.section_id, r.section_type) for (d, _, _), r in s.items() if d == "q")
    assert [x[1] for x in q] == ["top1", "ch1", "ch11", "ch11:x1", "top1:o5", "top1:o5:o6"]
    assert q[4][2] == "reference" and q[5][2] == "reference"
    assert s[("q", "第十一章 c", 8)].evidence_levels == [1, 2]
    assert s[("flat", "(untitled)", 1)].end_line == 3
    assert duplicate_section_ids(sections_table(parsed)).count() == 0

    b = [(r.document_id, r.block_type, r.start_line, r.end_line) for r in blocks_table(parsed).collect()]
    assert ("n", "table", 19, 21) in b
    m = sorted(x[1:] for x in b if x[0] == "m")
    assert m == [
        ("ascii_diagram", 25, 27), ("code", 17, 19), ("formula", 11, 13), ("mermaid", 21, 23),
        ("prose", 9, 9), ("prose", 31, 31),
    ]
    meta = {r.document_id: r.metadata for r in parsed.collect()}
    assert meta["m"] == {"report_code": "Q12", "domain": "power", "title": "Top"}
    assert meta["q"] == {"report_code": "Q05", "completed_at": "2026-08-27", "note": "bar", "title": "T"}
    assert meta["flat"] == {}
    parsed.unpersist()


def test_numerals(spark):
    given = {"一": 1, "十": 10, "十一": 11, "二十三": 23, "一百零四": 104, "100": 100, "甲": 0, "0012": 12, "1234567890": 1234567890}
    df = spark.createDataFrame([(k,) for k in given], "s string").select("s", numeral_value(F.col("s")).alias("v"))
    assert {r.s: r.v for r in df.collect()} == {k: str(v) for k, v in given.items()}


def test_places_as_section_ids(spark):
    docs = [("d", "# 94.182.225.142 first\n## 1.2 second\n### (3) third\n### 12\n## 第 2 章")]
    parsed = parse_documents(spark.createDataFrame(docs, "document_id string, text string"), numbered=False)
    got = [r.section_id for r in sections_table(parsed).orderBy("ordinal").collect()]
    assert got == ["top1", "top1:o2", "top1:o2:o3", "top1:o2:o4", "top1:o5"]


def _sf(tmp_path, spark, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_heading_tree_of_numbered_lines(spark, tmp_path):
    from fathomtext.registered.corpus import heading_tree

    text = "94.182.225.142 first\n1.2 second\n" + "3.4 " + "w" * 60
    sf = _sf(tmp_path, spark, "documents", [(7, text)], "doc_id long, text string")
    got = [(r.id, r.parent_section_id) for r in heading_tree(spark, sf).orderBy("ordinal").collect()]
    assert got == [("7:top1", None), ("7:top1:o2", "7:top1"), ("7:top1:o2:o3", "7:top1:o2")]


def test_sections_and_counts_of_odd_lines(spark, tmp_path):
    """Texts without lines have no sections and no counts; a long line of its own marks is no heading."""
    from fathomtext.registered.corpus import document_detail, heading_tree, index_counts

    texts = ["", None, "\n", "title\n# " + "w" * 90 + "\nReferences VS", "#"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    sf = _sf(tmp_path, spark, "documents", rows, "doc_id long, text string, lang string, source string")
    _sf(tmp_path, spark, "labels", [(0, 1)], "doc_id long, quality int")
    got = [(r.id, r.heading, r.section_type, r.end_line) for r in heading_tree(spark, sf).orderBy("document_id", "ordinal").collect()]
    assert got == [
        ("2:top1", "", "body", 1),
        ("3:top1", "title", "body", 2),
        ("3:top1:o2", "References VS", "comparison", 3),
        ("4:top1", "", "body", 1),
    ]
    got = [(r.id, r.section_count, r.chunk_count) for r in document_detail(spark, sf).orderBy("id").collect()]
    assert got == [(0, 0, 0), (1, 0, 0), (2, 1, 1), (3, 2, 3), (4, 1, 1)]
    assert [r.document_id for r in index_counts(spark, sf).orderBy("document_id").collect()] == [2, 3, 4]


def test_resolved_judgments_of_numbered_titles(spark, tmp_path):
    from fathomtext.registered.quality import resolved_judgments

    sf = _sf(tmp_path, spark, "pages", [(5, "<h1>94.182.225.142 first</h1><p>x</p>")], "page_id long, html string")
    assert [(r.query_id, r.section_id, r.grade) for r in resolved_judgments(spark, sf).collect()] == [(5, "5:top1", 3)]


def test_chunk_gates_of_numbered_lines(spark, tmp_path):
    from fathomtext.registered.corpus import chunk_gates

    sf = _sf(tmp_path, spark, "documents", [(7, "94.182.225.142 first " + "w" * 90)], "doc_id long, text string")
    assert [(r.cross_section, r.gate_passed) for r in chunk_gates(spark, sf).collect()] == [(0, True)]
