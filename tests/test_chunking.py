"""Chunk boundaries, formula context, overlap, inheritance and gates."""

from pyspark.sql import functions as F

from fathomtext.functions.text import plain_text
from fathomtext.operators.chunking import chunk_gates, chunk_stats, chunk_table, recheck
from fathomtext.operators.reconcile import sampled_recheck
from fathomtext.operators.structure import blocks_table, parse_documents, sections_table
from fathomtext.registered import corpus

FORMULA = "# T\n\n## 1.1 S\n\nshort reason.\n\n$$\na\n$$\n\nafter one\n\n$$\nb\n$$\n\n$$\nc\n$$\n\nafter two\n\n| a | b |\n|---|---|\n| **1** | `2` |\n"
PROSE = "# T\n\n> q\n\n## 1.1 S\n\n" + "\n\n".join(f"p{i}" + "w" * 328 for i in range(8))
SMALL_TAIL = "# T\n\n## S\n\n" + "\n\n".join(["x" * 900, "y" * 250, "z" * 600])
LONG = "# T\n\n## S\n\n" + "长句。" * 900 + "\n\n" + "x" * 5000
INHERIT = "# T\n\n## S\n\n[L3] marked\n\n```\ncode\n```\n\n[L2] [L5] more"


def test_chunks(spark):
    docs = [("f", FORMULA), ("p", PROSE), ("o", SMALL_TAIL), ("l", LONG), ("i", INHERIT)]
    parsed = parse_documents(spark.createDataFrame(docs, "document_id string, text string")).persist()
    chunks = chunk_table(parsed).persist()
    by = {}
    for r in chunks.orderBy("document_id", "ordinal").collect():
        by.setdefault(r.document_id, []).append(r)

    f = by["f"]
    assert [r.content_type for r in f] == ["formula", "formula", "formula", "table"]
    assert f[0].raw_markdown.startswith("short reason.") and f[1].raw_markdown.startswith("after one")
    assert f[2].raw_markdown.endswith("after two")
    assert f[0].id == "f:ch1-1:0001" and (f[3].start_line, f[3].end_line) == (23, 25)

    assert [len(r.raw_markdown.split("\n\n")) for r in by["p"]] == [4, 4]
    o = by["o"]
    # The short last paragraph of the first chunk opens the second one again.
    assert [len(r.raw_markdown) for r in o] == [1152, 852] and o[1].raw_markdown.startswith("y")
    assert [(r.start_line, r.end_line) for r in o] == [(5, 7), (7, 9)]
    assert [len(r.raw_markdown) for r in by["l"]] == [900, 900, 900, 2200, 2200, 600]
    code = [r for r in by["i"] if r.content_type == "code"][0]
    assert code.evidence_levels == [2, 3, 5] and code.evidence_level == 2
    assert by["i"][0].embedding_text.startswith("Document: T\nDomain: unknown\nSection: T > S\nContent Type: prose\nEvidence: L3\n\n")

    gates = chunk_gates(chunks, sections_table(parsed), blocks_table(parsed), parsed)
    assert [r.gate_passed for r in gates.collect()] == [True] * 5
    changed = chunks.withColumn("end_line", F.when(F.col("id") == "f:ch1-1:0001", 99).otherwise(F.col("end_line")))
    assert {(r.id, r.side) for r in recheck(changed, parsed).collect()} == {("f:ch1-1:0001", "stored"), ("f:ch1-1:0001", "fresh")}
    stats = chunk_stats(chunks).first()
    assert stats.chunk_count == chunks.count() and stats.max == 2200
    chunks.unpersist()
    parsed.unpersist()


def test_plain_text(spark):
    md = "**HBM4** uses `CoWoS-L`, see [doc](http://x.y) ![i](j)\n\n\n\n| a | b |\n|---|---|\n## h\nC_{x}d_{y}"
    got = spark.createDataFrame([(md,)], "t string").select(plain_text(F.col("t")).alias("p")).first().p
    assert "HBM4 uses CoWoS-L, see doc" in got and "http" not in got and "**" not in got
    assert got.endswith("h\nC{x}d{y}")


def test_long_lines_cut_by_length(spark, tmp_path):
    from fathomtext.registered.corpus import prose_packing

    text = "Go! " * 600 + "end"
    spark.createDataFrame([(3, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.id, r.n_chars) for r in prose_packing(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert got == [("3:top1:0001", 2200), ("3:top1:0002", 203)]


def test_rest_without_plain_text_is_no_chunk(spark, tmp_path):
    """What a hard cut leaves of a paragraph may be signs alone."""
    rests = ["|", "-", ": -", "rest"]
    rows = [(i, "title\n" + "word " * 440 + rest) for i, rest in enumerate(rests)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    gates = corpus.real_chunk_gates(spark, str(tmp_path)).collect()
    assert len(gates) == 4 and all(r.gate_passed and r.empty_chunk == 0 for r in gates)
    parsed = parse_documents(docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("# "), "text").alias("text")))
    chunks = chunk_table(parsed).orderBy("document_id", "ordinal").collect()
    assert [len([c for c in chunks if c.document_id == str(i)]) for i in range(4)] == [1, 1, 1, 2]
    assert all([c.raw_markdown for c in chunks if c.document_id == str(i)][-1].endswith(rest) for i, rest in enumerate(rests))


def test_real_chunk_gates_parse_each_text_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"title {i}\nshort\n" + "w " * 50) for i in range(6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made, marked = spark.sparkContext.accumulator(0), corpus.inputs.marked_documents
    counted = F.udf(lambda x: (made.add(1), x)[1], "string")
    monkeypatch.setattr(corpus.inputs, "marked_documents", lambda *a: marked(*a).withColumn("text", counted("text")))
    rows = corpus.real_chunk_gates(spark, str(tmp_path)).collect()
    assert len(rows) == 6 and all(r.gate_passed for r in rows)
    assert made.value <= 6


def test_sampled_recheck_reads_the_store_once(spark):
    """Rows of the store are made once, whatever is compared with them."""
    texts = spark.createDataFrame([(str(i), f"# T{i}\n\n## 1.1 S\n\nwords {i}") for i in range(6)], "document_id string, text string")
    parsed = parse_documents(texts).persist()
    calls = {name: spark.sparkContext.accumulator(0) for name in ("title", "heading", "content_type")}

    def counted(name):
        made = calls[name]
        return F.udf(lambda x: (made.add(1), x)[1], "string")(name)

    documents = parsed.select(F.col("document_id").alias("id"), counted("title").alias("title"))
    sections = sections_table(parsed).withColumn("heading", counted("heading"))
    chunks = chunk_table(parsed).withColumn("content_type", counted("content_type"))
    rows = sampled_recheck(texts, documents, sections, chunks, 2, 3).collect()
    assert len(rows) == 2 and all(r.passed for r in rows)
    assert calls["title"].value <= 6 and calls["heading"].value <= 12 and calls["content_type"].value <= 6
    parsed.unpersist()
