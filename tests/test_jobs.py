"""Index build from files, incremental runs, search on the store, streaming."""

import collections
import os
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fathomtext.operators import dense, lexical, reconcile
from fathomtext.plans import indexing
from fathomtext.plans.indexing import open_index, reconcile_files
from fathomtext.plans.search import SearchOptions, search
from fathomtext.registered import packs, versions
from fathomtext.sources import files, snapshots
from fathomtext.streaming.ingest import reconcile_batch, watch_files

REPORT = "# {t}\n\n> **专题代号**：`{c}_x`\n\n## 1.1 Process\n\nThe {w} package uses CoWoS-L here.\n\n## 1.2 Market\n\nPrices of {w} rise.\n"


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_incremental_index_and_search(spark):
    root, store = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    one = write(root, "one_最终报告.md", REPORT.format(t="One", c="A1", w="turbine"))
    write(root, "two_最终报告.MD", REPORT.format(t="Two", c="B2", w="transformer"))
    write(root, "~$lock_最终报告.md", "x")
    write(root, "skip.md", "# not admitted")
    with open(os.path.join(root, "bad_最终报告.md"), "wb") as f:
        f.write(b"\xff\xfe\x00bad")
    states = reconcile_files(spark, [root], store, "v1")
    assert {r.status for r in states.collect()} == {"NEW", "ERROR"}
    index = open_index(spark, store)
    assert {r.id for r in index.documents.collect()} == {"A1", "B2"}

    q = spark.createDataFrame([(1, "transformer CoWoS-L"), (2, "turbine prices")], "query_id int, query string")
    qv = q.select("query_id", dense.hashed_embedding(F.col("query")).alias("embedding"))
    hits = search(q, index, qv, SearchOptions(top_k=3, rerank=True)).collect()
    first = {r.query_id: r for r in hits if r.rank == 1}
    assert first[1].document_id == "B2" and first[2].chunk_id == "A1:ch1-2:0002"
    assert first[2].section_boost == 1.08 and first[1].snippet
    counts = reconcile.document_counts(
        index.documents, index.chunks, index.terms.lengths, index.grams.lengths, index.vectors
    )
    assert all(r.ok for r in counts.collect())

    os.rename(one, os.path.join(root, "moved_最终报告.md"))
    write(root, "two_最终报告.MD", REPORT.format(t="Two", c="B2", w="inverter"))
    again = {r.status for r in reconcile_files(spark, [root], store, "v2").collect()}
    assert again == {"RENAMED", "MODIFIED", "UNCHANGED", "ERROR"} or again == {"RENAMED", "MODIFIED", "NEW", "ERROR"}
    after = open_index(spark, store)
    docs = {r.id: r for r in after.documents.collect()}
    assert docs["A1"].file_name == "moved_最终报告.md" and set(docs) == {"A1", "B2"}
    texts = [r.plain_text for r in after.chunks.where("document_id = 'B2'").collect()]
    assert len(texts) == 2 and all("inverter" in t for t in texts)



def test_watch_sees_every_kind_of_change_with_one_checkpoint(spark):
    root, store, offsets = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    write(root, "one_最终报告.md", REPORT.format(t="One", c="A1", w="turbine"))
    run = reconcile_batch(spark, [root], store, "watch")
    tick = lambda: watch_files(spark, run, offsets, once=True).awaitTermination()
    names = lambda: {r.id: r.file_name for r in open_index(spark, store).documents.collect()}
    tick()
    assert names() == {"A1": "one_最终报告.md"}
    first = snapshots.current_version(spark, store)
    write(root, "two_最终报告.md", REPORT.format(t="Two", c="B2", w="transformer"))
    tick()
    assert set(names()) == {"A1", "B2"} and snapshots.current_version(spark, store) > first
    write(root, "two_最终报告.md", REPORT.format(t="Two", c="B2", w="inverter again"))
    os.rename(os.path.join(root, "one_最终报告.md"), os.path.join(root, "moved_最终报告.md"))
    tick()
    assert names() == {"A1": "moved_最终报告.md", "B2": "two_最终报告.md"}
    assert all("inverter" in r.plain_text for r in open_index(spark, store).chunks.where("document_id = 'B2'").collect())
    os.remove(os.path.join(root, "two_最终报告.md"))
    tick()
    assert set(names()) == {"A1"}
    now = snapshots.current_version(spark, store)
    run(int(now.rsplit("-", 1)[1]))
    tick()
    assert snapshots.current_version(spark, store) == now


def tree(folder):
    """Data files below a store with their times."""
    return {
        os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns
        for at, _, names in os.walk(os.path.join(folder, "data")) for f in names if f.endswith(".parquet")
    }


def search_hits(spark, store):
    q = spark.createDataFrame([(1, "w3 CoWoS-L"), (2, "w7 prices")], "query_id int, query string")
    qv = q.select("query_id", dense.hashed_embedding(F.col("query")).alias("embedding"))
    return {tuple(r) for r in search(q, open_index(spark, store), qv, SearchOptions(top_k=5)).drop("snippet").collect()}


def test_a_version_writes_only_the_buckets_that_change(spark):
    root, store, whole = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    for i in range(12):
        write(root, f"r{i}_最终报告.md", REPORT.format(t=f"R{i}", c=f"A{i}", w=f"w{i}"))
    reconcile_files(spark, [root], store, "v1", buckets=8)
    before = tree(store)
    write(root, "r3_最终报告.md", REPORT.format(t="R3", c="A3", w="w3 changed"))
    reconcile_files(spark, [root], store, "v2", buckets=99)
    after = tree(store)
    assert all(after[f] == t for f, t in before.items())
    mine = spark.range(1).select(snapshots.bucket_of(F.lit("A3"), 8)).first()[0]
    fresh = {f for f in after if f not in before}
    assert fresh and all(f"/v2/" in f and f"bucket={mine}/" in f for f in fresh)
    # A run that dies before its pointer changes nothing for readers; its name can be used again.
    write(root, "r5_最终报告.md", REPORT.format(t="R5", c="A5", w="w5 changed"))
    old = {r.id: r.sha256 for r in open_index(spark, store).documents.collect()}

    def dies(df):
        raise RuntimeError("lost")

    broken = {"term_blocks": ("postings", dies)}
    kept = indexing.DERIVED
    try:
        indexing.DERIVED = broken
        with pytest.raises(RuntimeError):
            reconcile_files(spark, [root], store, "v3")
    finally:
        indexing.DERIVED = kept
    assert snapshots.current_version(spark, store) == "v2"
    assert {r.id: r.sha256 for r in open_index(spark, store).documents.collect()} == old
    os.remove(os.path.join(root, "r7_最终报告.md"))
    reconcile_files(spark, [root], store, "v3")
    # Step by step or at once: the same tables and the same results.
    reconcile_files(spark, [root], whole, "w1")
    for name in ("sections", "chunks", "postings", "term_lengths", "grams", "gram_lengths", "vectors", "section_vectors"):
        rows = lambda at: sorted(map(str, snapshots.read_table(spark, at, name).collect()))
        assert rows(store) == rows(whole), name
    stats = lambda at: {tuple(r) for r in open_index(spark, at).terms.term_stats().collect()}
    assert stats(store) == stats(whole) == {tuple(r) for r in lexical.term_stats(open_index(spark, whole).terms.postings).collect()}
    assert search_hits(spark, store) == search_hits(spark, whole)
    unused = snapshots.unused_folders(spark, store, keep=1)
    named = {r["path"] for r in snapshots.manifest(spark, store, "v3")}
    assert unused and not named & set(unused)


def test_run_state_counts_only_with_its_pointer(spark):
    root, store = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    for i in range(4):
        write(root, f"r{i}_最终报告.md", REPORT.format(t=f"R{i}", c=f"A{i}", w=f"w{i}"))
    write(root, "skip.md", "# refused by its name")
    reconcile_files(spark, [root], store, "v1")
    assert indexing.deletions(spark, store).count() == 0
    assert {r.status: r.n for r in indexing.last_scan(spark, store).collect()} == {"NEW": 5}
    os.remove(os.path.join(root, "r1_最终报告.md"))
    # Rows of a run that never published do not count.
    spark.createDataFrame([("x", "A9", "s", "t")], indexing.DELETIONS).write.parquet(f"{store}/_log/deletions/version=lost")
    reconcile_files(spark, [root], store, "v2")
    gone = indexing.deletions(spark, store).collect()
    assert [r.document_id for r in gone] == ["A1"] and gone[0].last_sha256 and "r1_" in gone[0].source_path
    assert {r.status: r.n for r in indexing.last_scan(spark, store).collect()} == {"UNCHANGED": 3, "DELETED": 1, "NEW": 1}
    # Nothing to do: nothing is published, and the refused file is not taken for work.
    reconcile_files(spark, [root], store, "v3")
    assert snapshots.current_version(spark, store) == "v2"
    before = {r.id: (r.indexed_at, r.created_at) for r in open_index(spark, store).documents.collect()}
    files_before = tree(store)
    indexing.reindex_document(spark, [root], store, "v4", "A2")
    after = {r.id: (r.indexed_at, r.created_at) for r in open_index(spark, store).documents.collect()}
    assert set(after) == set(before)
    assert after["A2"][0] > before["A2"][0] and after["A2"][1] == before["A2"][1]
    mine = spark.range(1).select(snapshots.bucket_of(F.lit("A2"), snapshots.BUCKETS)).first()[0]
    assert all(f"bucket={mine}/" in f for f in tree(store) if f not in files_before)
    assert [(r.id, r.kind) for r in indexing.jobs(spark, store).collect()] == [("v4", "reindex"), ("v2", "reconcile"), ("v1", "reconcile")]
    # The same batch run twice after a failure before its pointer leaves one row.
    assert indexing.deletions(spark, store).count() == 1


def test_json_sources(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    write(folder, "e.jsonl", '{"a": 1}\n\nnot json\n{"a": 2, "more": 3}\n')
    assert {r.a for r in files.read_json_lines(spark, f"{folder}/e.jsonl", "a int").collect()} == {1, 2}
    docs = tempfile.mkdtemp(prefix="spark-")
    write(docs, "a.json", '\ufeff{"k": "v"}')
    write(docs, "b.json", "{broken")
    got = {os.path.basename(r.path): r.value for r in files.read_json_documents(spark, docs, "struct<k:string>").collect()}
    assert got["a.json"].k == "v" and got["b.json"] is None


def test_a_second_write_replaces_only_its_own_folders(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/out"
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "task string, n int")
    files.write_json(df, folder, ["task"])
    kept = {f: os.stat(f"{folder}/task=b/{f}").st_mtime_ns for f in os.listdir(f"{folder}/task=b")}
    files.write_json(spark.createDataFrame([("a", 9), ("c", 4)], "task string, n int"), folder, ["task"])
    got = {(r.task, r.n) for r in files.read_json_folders(spark, folder, "task string, n int").collect()}
    assert got == {("a", 9), ("b", 3), ("c", 4)}
    assert kept == {f: os.stat(f"{folder}/task=b/{f}").st_mtime_ns for f in os.listdir(f"{folder}/task=b")}


def test_files_of_task_answers_do_not_grow_with_the_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, t, "assistant", f"x{i} {t}") for i in range(200) for t in (1, 3, 5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(2).write.parquet(f"{tmp_path}/in/conversations.parquet")
    monkeypatch.setattr(versions, "working_folder", lambda spark: f"{tmp_path}/work")
    got = collections.defaultdict(list)
    for r in versions.task_files(spark, f"{tmp_path}/in").collect():
        got[r.conv_id].append((r.turn, r.answer.startswith("again ")))
    assert all(sorted(v) == ([(1, True), (3, True)] if i % 3 == 0 else [(1, False), (3, False), (5, False)]) for i, v in got.items()) and len(got) == 200
    assert sum(len([f for f in names if f.endswith(".json")]) for _, _, names in os.walk(f"{tmp_path}/work")) < 50
    # A run that did not finish does not count, and a later one does not take its place.
    os.makedirs(f"{tmp_path}/work/answers/run=000002")
    write(f"{tmp_path}/work/answers/run=000002", "part.json", '{"conv_id": 1, "turn": 1, "answer": "lost"}')
    files.write_run(spark.createDataFrame([(2, 9, "new")], "conv_id long, turn long, answer string"), f"{tmp_path}/work/answers")
    last = files.read_runs(spark, f"{tmp_path}/work/answers", "conv_id bigint, turn bigint, answer string", ["conv_id"])
    assert [r.answer for r in last.where("conv_id = 2").collect()] == ["new"] and last.where("answer = 'lost'").count() == 0
    assert files.read_runs(spark, f"{tmp_path}/none", "conv_id bigint", ["conv_id"]).count() == 0


def test_gates_do_not_join_in_one_plan(spark):
    rows, drafts = packs._gate_rows(spark, "/root/testdata/sf0.001")
    for df in (rows, drafts):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert rows.select("step").distinct().count() == 7


def test_entry_contract(spark):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 70
    assert entry.entry(spark).count() > 0


def test_a_scan_of_many_files_is_one_batch(spark, tmp_path):
    from fathomtext.streaming.ingest import LISTING, announce_listing, track_listings

    listings = f"{tmp_path}/listings"
    rows = lambda ids, sha: spark.createDataFrame([(f"p{i}", 1, i, sha, None) for i in ids], LISTING).repartition(3)
    for n, scan in enumerate((rows(range(9), "a"), rows(range(1, 10), "b"))):
        scan.write.parquet(f"{listings}/scan={n}")
        announce_listing(spark, listings, f"scan={n}")
    assert len(list((tmp_path / "listings" / "scan=0").glob("*.parquet"))) == 3
    states = track_listings(spark, listings, str(tmp_path))
    got = {(r.batch, r.status): r["count"] for r in states.groupBy("batch", "status").count().collect()}
    assert sum(n for (b, _), n in got.items() if b == 0) == 9 and got[1, "DELETED"] == 1
    assert {b for b, _ in got} == {0, 1} and sum(n for (b, _), n in got.items() if b == 1) == 10
