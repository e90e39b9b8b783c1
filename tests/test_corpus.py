"""Admission, change detection, catalog updates, grounding and gates."""

from pyspark.sql import functions as F

from fathomtext.registered import inputs
from fathomtext.operators import admission, catalog, changes, gates, grounding


def test_admission_rules(spark):
    cases = {
        "kb/版本存档/x_最终报告.md": "EXCLUDED_DIR", "kb/a/01_最终报告.md": "EXCLUDED_PROCESS", "kb/a/10_x.md": "EXCLUDED_PROCESS",
        "kb/a/开题报告.md": "EXCLUDED_PROCESS", "kb/a/notes.md": "EXCLUDED_NON_FINAL", "kb/a/11_最终报告.md": None, "C:\\kb\\a\\最终报告.md": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    assert {r.path: r.x for r in df.select("path", admission.exclusion_reason(F.col("path")).alias("x")).collect()} == cases
    ids = {
        ("kb/Topic/11_最终报告.md", None): "Topic", ("kb/Topic/M14_最终报告.md", None): "M14", ("kb/T/x_负知识.md", "M04"): "M04__负知识",
        ("kb/T/x_思维增量.md", None): "T__思维增量", ("kb/T/a最终报告.md", "M05"): "M05", ("kb/T/a最终报告.md", None): "a最终报告",
    }
    df = spark.createDataFrame(list(ids), "path string, code string")
    got = df.select("path", "code", admission.default_doc_id(F.col("path"), F.col("code")).alias("x")).collect()
    assert {(r.path, r.code): r.x for r in got} == ids


def test_ids_duplicates_and_collisions(spark):
    rows = [("kb/z/最终报告.md", "A", "s1"), ("kb/02_主题研究报告/最终报告.md", "A", "s1"), ("kb/y/最终报告.md", "A", "s2222222222"), ("kb/q/b.md", "B", "s3"), ("kb/qq/b.md", "B", "s3")]
    known = spark.createDataFrame([("B", "s3", "old/b.md")], "id string, sha256 string, source_path string")
    ass, exc = admission.assign_ids(spark.createDataFrame(rows, "path string, default_id string, sha256 string"), known)
    assert {r.path: r.document_id for r in ass.collect()} == {"kb/02_主题研究报告/最终报告.md": "A", "kb/y/最终报告.md": "A__s2222222"}
    assert {r.path: r.kept_path for r in exc.collect()} == {
        "kb/z/最终报告.md": "kb/02_主题研究报告/最终报告.md", "kb/q/b.md": "old/b.md", "kb/qq/b.md": "old/b.md",
    }


def test_six_states(spark):
    listing = spark.createDataFrame(
        [("same", 1, 1, None, None), ("touched", 1, 9, "h2", None), ("edited", 2, 9, "new", None), ("moved", 1, 1, "h4", None),
         ("fresh", 1, 1, "h9", None), ("broken", 1, 1, None, "io")],
        "path string, size long, mtime_ms long, sha256 string, error string",
    )
    manifest = spark.createDataFrame(
        [("1", "same", 1, 1, "h1"), ("2", "touched", 1, 1, "h2"), ("3", "edited", 1, 1, "h3"), ("4", "was", 1, 1, "h4"), ("5", "gone", 1, 1, "h5")],
        "id string, path string, size long, mtime_ms long, sha256 string",
    )
    got = {r.path: (r.status, r.renamed_from, r.document_id) for r in changes.scan_diff(listing, manifest).collect()}
    assert got == {
        "same": ("UNCHANGED", None, "1"), "touched": ("UNCHANGED", None, "2"), "edited": ("MODIFIED", None, "3"),
        "moved": ("RENAMED", "was", "4"), "fresh": ("NEW", None, None), "broken": ("ERROR", None, None), "gone": ("DELETED", None, "5"),
    }
    hashed = {r.path for r in changes.needs_hash(listing, manifest).collect()}
    assert hashed == {"touched", "edited", "moved", "fresh", "broken"}


def test_catalog_updates(spark):
    old = spark.createDataFrame([("a", "1", "t0"), ("b", "1", "t0")], "id string, v string, created_at string")
    new = spark.createDataFrame([("b", "2", "t1"), ("c", "2", "t1")], "id string, v string, created_at string")
    assert {tuple(r) for r in catalog.upsert(old, new).collect()} == {("a", "1", "t0"), ("b", "2", "t0"), ("c", "2", "t1")}
    runs = spark.createDataFrame([("k", "1", 1), ("k", "2", 2)], "key string, value string, at int")
    assert [tuple(r) for r in catalog.latest_values(runs).collect()] == [("k", "2")]
    got = spark.range(1).select(catalog.second_corpus_id(F.lit("/r/03_q/x.y.md"), "/r").alias("i")).first().i
    assert got == "cog:03_q/x.y"


def drafts(spark):
    claims = "array<struct<id:string,text:string,epistemic_state:string,evidence_refs:array<string>,rationale:string>>"
    tensions = "array<struct<id:string,text:string,evidence_refs:array<string>>>"
    rows = [
        ("good", [("c1", "x", "supported", ["k1"], None), ("c2", "y", "uncertain", [], None)], []),
        ("bad", [("c1", "x", "supported", ["k9"], None), ("c1", "y", "inference", [], None)], [("t", "z", ["k8"])]),
        ("none", [("c1", "x", "uncertain", [], None)], []),
    ]
    return spark.createDataFrame(rows, f"task_id string, claims {claims}, tensions {tensions}")


def test_validation_and_gate_order(spark):
    ev = spark.createDataFrame([("good", "k1", "h1"), ("bad", "k1", "h1"), ("none", "k1", "h1")], "task_id string, chunk_id string, content_hash string")
    reports = grounding.validate_drafts(drafts(spark), ev)
    got = {r.task_id: r for r in grounding.automatic_gate(reports).collect()}
    assert got["good"].passed and got["good"].citation_coverage == 1.0
    assert (got["bad"].citation_invalid, got["bad"].duplicate_claim_ids, got["bad"].schema_valid) == (2, 1, False)
    assert got["none"].citation_coverage is None and not got["none"].passed
    tasks = drafts(spark).select("task_id")
    rows = gates.citation_gate(tasks, reports).unionByName(gates.membership_gate(
        tasks, spark.createDataFrame([("bad", "k9"), ("good", "k1")], "task_id string, chunk_id string"), ev
    ))
    _, final = gates.in_order(rows)
    assert {r.task_id: r.first_failure for r in final.collect()} == {
        "good": None, "bad": "evidence_membership", "none": "citation_coverage"
    }


def test_result_schema_gate(spark):
    schema = (
        "pack_id string, schema_version string, task_id string, task_type string, query string, generated_at string, "
        "worker struct<tool:string,model:string>, claims array<struct<id:string,text:string,epistemic_state:string>>, "
        "tensions array<struct<id:string,text:string>>, additional_evidence_needed array<struct<question:string,reason:string>>"
    )
    ok = ("p1", "1.0", "p1", "summary", "q", "now", ("tool", None), [("c", "t", "supported")], [], [])
    rows = [ok, ("p2", *ok[1:3], "other", *ok[4:]), ("p3", "1.0", "../x", *ok[3:]), ("p4", *ok[1:7], [("c", "t", "maybe")], [], [])]
    r = spark.createDataFrame(rows, schema)
    tasks = spark.createDataFrame([(f"p{i}",) for i in range(1, 6)], "task_id string")
    got = {x.task_id: x.passed for x in gates.schema_gate(tasks, r).collect()}
    assert got == {"p1": True, "p2": False, "p3": False, "p4": False, "p5": False}


def test_slug_and_task_ids(spark):
    rows = [(1, "Why HBM4 matters?"), (2, "中文"), (3, "中文"), (4, "why hbm4 matters")]
    df = spark.createDataFrame(rows, "seq long, query string").withColumn("created_at", F.to_timestamp(F.lit("2026-01-02 03:04:05")))
    assert {r.seq: r.task_id for r in grounding.task_ids(df).collect()} == {
        1: "20260102_030405_why-hbm4-matters", 4: "20260102_030405_why-hbm4-matters-2",
        2: "20260102_030405_task", 3: "20260102_030405_task-2",
    }


def test_tables_of_several_files_are_not_shuffled(spark, tmp_path):
    """Four cores: three files are read as they are, one file is spread."""
    rows = spark.range(100).selectExpr("id AS doc_id", "'text' AS text")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    assert inputs.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() <= 3
    assert inputs.table(spark, str(tmp_path), "labels").rdd.getNumPartitions() == 4
    assert inputs.table(spark, str(tmp_path), "documents").count() == inputs.table(spark, str(tmp_path), "labels").count() == 100
