"""Search against brute force."""

import math
import random
import re
import time
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomtext.functions import text
from fathomtext.functions.stats import nearest_rank, numbered
from fathomtext.functions.skew import hot_keys, lookup_join
from fathomtext.functions.text import TermTrie, highlight, identifiers, lexical_text, normal_form, snippet, terms
from fathomtext.operators import dense, evaluation, fusion, lexical
from fathomtext.sources.staging import staged

TEXTS = {
    "a": "CoWoS-L packages HBM4 dies. CoWoS-L again, and banana banana bananana.",
    "b": "the cowos process; L is separate from cowos and the dies are thin",
    "c": "nothing of note 60mV/dec here, the dies die",
    "d": "台积电的先进封装 CoWoS-L 与 HBM4",
    "e": "unrelated words only",
}


def corpus(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id string, raw_markdown string").withColumn("heading_path", F.lit("Head line"))
    return df.withColumn("lexical_text", lexical_text(F.col("raw_markdown")))


def queries(spark):
    return spark.createDataFrame([(1, "CoWoS-L dies"), (2, "banana ana dies"), (3, "先进封装")], "query_id int, query string")


def test_identifiers_and_text(spark):
    df = spark.createDataFrame([("CoWoS-L, EXE:5000 and 60mV/dec N3E plain C++ a-b CoWoS-L 429mm²",)], "t string")
    assert df.select(identifiers(F.col("t")).alias("x")).first().x == [
        "CoWoS-L", "EXE:5000", "60mV/dec", "N3E", "C++", "a-b", "429mm²"
    ]
    body = "x" * 300 + " needle " + "y" * 300
    got = spark.createDataFrame([(body, "find needle", "Some Needle words")], "t string, q string, h string").select(
        snippet(F.col("t"), F.col("q")).alias("s"), highlight(F.col("h"), F.col("q")).alias("h")
    ).first()
    assert got.s.startswith("…") and got.s.endswith("…") and "needle" in got.s and len(got.s) == 202
    assert got.h == "Some <mark>Needle</mark> words"


def test_terms_bm25_with_phrases(spark):
    chunks = corpus(spark)
    index = lexical.term_index(chunks)
    phrases = lexical.query_phrases(queries(spark))
    got = {
        (r.query_id, r.chunk_id): r.score
        for r in lexical.bm25(phrases, lexical.phrase_hits(phrases, index), index.lengths).collect()
    }
    docs = {}
    for r in chunks.collect():
        docs[r.id] = ["head", "line", None] + re.findall(r"\w+", r.lexical_text.lower())
    n = len(docs)
    dl = {k: len(v) - 1 for k, v in docs.items()}
    avg = sum(dl.values()) / n
    for q in (1, 2):
        want = Counter()
        for ph in [r for r in phrases.collect() if r.query_id == q]:
            m = len(ph.tokens)
            tf = {k: sum(v[i:i + m] == list(ph.tokens) for i in range(len(v))) for k, v in docs.items()}
            df = sum(x > 0 for x in tf.values())
            idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) if df else 0
            for k, x in tf.items():
                if x:
                    want[k] += idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * dl[k] / avg))
        mine = {k[1]: v for k, v in got.items() if k[0] == q}
        assert set(mine) == set(want)
        assert all(abs(mine[k] - want[k]) < 1e-9 for k in want)


def test_substrings_stored_equal_scanned_equal_brute_force(spark):
    chunks = corpus(spark)
    index = lexical.gram_index(chunks)
    phrases = lexical.query_substrings(queries(spark))
    as_set = lambda df: {(r.phrase, r.chunk_id, r.tf) for r in df.collect()}
    stored, scanned = as_set(lexical.substring_hits(phrases, index)), as_set(lexical.scanned_substring_hits(phrases, index))
    brute = set()
    for p in {r.phrase for r in phrases.collect()}:
        for k, t in TEXTS.items():
            n = sum(len(re.findall(f"(?={re.escape(p)})", x)) for x in (t.lower(), "head line"))
            if n:
                brute.add((p, k, n))
    assert stored == scanned == brute
    texts = chunks.select(F.col("id").alias("chunk_id"), F.col("raw_markdown").alias("plain_text"))
    wanted = spark.createDataFrame([(1, "CoWoS-L"), (2, "L"), (3, "di"), (4, "dies d")], "query_id int, query string")
    truth = {(r.query_id, r.chunk_id) for r in lexical.substring_truth(wanted, index, texts).collect()}
    assert truth == {(q.query_id, k) for q in wanted.collect() for k, t in TEXTS.items() if q.query in t}


def zipf_corpus(spark, n=400):
    """Texts in which few words are in nearly every one, queries of common and rare words."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(20, 120)))) for i in range(n)]
    asked = [(q, " ".join([*rnd.choices(words[:8], k=6), *rnd.sample(words[60:], 3)])) for q in range(12)]
    asked += [(90, "w0 w1 w2"), (91, "w299"), (92, "absent words"), (93, "w7-w3 w250 w0")]
    chunks = spark.createDataFrame(texts, "id int, plain_text string").withColumn("heading_path", F.lit(""))
    return chunks, spark.createDataFrame(asked, "query_id int, query string")


def test_pruned_search_scores_few_pairs_and_loses_none(spark):
    chunks, asked = zipf_corpus(spark)
    phrases = lexical.query_phrases(asked)
    index = lexical.term_index(chunks, text_col="plain_text")
    index = lexical.TermIndex(staged(index.postings), staged(index.lengths))
    key = lambda df: {(r.query_id, r.chunk_id, r["rank"], round(r.score, 8)) for r in df.collect()}
    hits = staged(lexical.phrase_hits(phrases, index))
    every = key(lexical.ranked_by_score(lexical.bm25(phrases, hits, index.lengths), 5))
    assert every == key(lexical.search_terms(phrases, index, 5))
    all_pairs = phrases.join(hits, "phrase").count()
    assert 4 * lexical.pruned_terms(phrases, index, 5).scored_pairs() < all_pairs
    # Statistics kept by part of the corpus give the same bounds.
    parts = lexical.term_stats(index.postings.withColumn("bucket", F.col("chunk_id") % 7), "bucket")
    assert {tuple(r) for r in lexical.whole_stats(parts).collect()} == {tuple(r) for r in lexical.term_stats(index.postings).collect()}
    substrings = lexical.query_substrings(asked)
    grams = lexical.gram_index(chunks, text_col="plain_text")
    grams = lexical.GramIndex(staged(grams.grams), grams.texts, staged(grams.lengths))
    found = lexical.substring_hits(substrings, grams)
    full = key(lexical.ranked_by_score(lexical.bm25(substrings, found, grams.lengths), 5))
    assert full == key(lexical.search_substrings(substrings, grams, 5))


def test_substrings_of_every_length(spark):
    rnd = random.Random(5)
    texts = [(i, "".join(rnd.choice("abAé ") for _ in range(rnd.randint(0, 60)))) for i in range(60)] + [(60, ""), (61, "a"), (62, "ab")]
    chunks = spark.createDataFrame(texts, "id int, raw_markdown string").withColumn("heading_path", F.lit("aba heading"))
    index = lexical.gram_index(chunks)
    asked = {"".join(rnd.choice("abAé ") for _ in range(n)) for n in range(1, 9) for _ in range(12)} | {t[5:40] for _, t in texts[:6] if len(t) > 40}
    q = spark.createDataFrame(list(enumerate(sorted(asked))), "query_id int, query string")
    held = chunks.select(F.col("id").alias("chunk_id"), F.col("raw_markdown").alias("plain_text"))
    got = [tuple(r) for r in lexical.substring_truth(q, index, held).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(n, i) for n, a in enumerate(sorted(asked)) for i, t in texts if a in t}
    phrases = q.where("length(query) >= 3").select(F.lower("query").alias("phrase")).distinct()
    hits = {(r.phrase, r.chunk_id): r.tf for r in lexical.substring_hits(phrases, index).collect()}
    count = lambda p, t: len(re.findall(f"(?={re.escape(p)})", t))
    want = {(p, i): count(p, t.lower()) + count(p, "aba heading") for p in {a.lower() for a in asked if len(a) >= 3} for i, t in texts}
    assert hits == {k: n for k, n in want.items() if n}


def test_cosine_blocks_against_brute_force(spark):
    rnd = np.random.default_rng(4)
    v, q = rnd.normal(size=(3000, 8)), rnd.normal(size=(40, 8))
    v[100:130] = v[7]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>").repartition(3)
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    scores = np.round(unit(q) @ unit(v).T, 9)
    want = {(i, int(j), n) for i in range(40) for n, j in enumerate(np.lexsort((np.arange(3000), -scores[i]))[:7], 1)}
    key = lambda df: {(r.query_id, r.chunk_id, r["rank"]) for r in df.collect()}
    assert key(dense.cosine_topk(vectors, asked, 7, block_bytes=1000)) == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        # Query blocks too large to broadcast meet the vectors partition by partition.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert key(dense.cosine_topk(vectors, asked, 7)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The embedding of a vector is computed once.
    texts = spark.createDataFrame([(1, "a b"), (2, "c")], "chunk_id long, t string")
    embedded = texts.select("chunk_id", dense.hashed_embedding(F.col("t"), 8).alias("embedding"))
    plan = dense.cosine_topk(embedded, asked, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_fusion_order_and_boost(spark):
    rows = [(1, "terms", "d:s1:0001", 1), (1, "trigram", "d:s1:0001", 3), (1, "dense", "d:s2:0002", 1), (1, "terms", "d:s2:o1:0003", 2)]
    lists = spark.createDataFrame(rows, "query_id int, source string, item_id string, rank int")
    fused = fusion.rrf(lists)
    got = {r.item_id: r for r in fused.collect()}
    assert abs(got["d:s1:0001"].rrf - (0.9 / 61 + 0.7 / 63)) < 1e-12
    assert got["d:s1:0001"].ranks == {"dense": None, "terms": 1, "trigram": 3}
    hits = spark.createDataFrame([(1, "d:s2")], "query_id int, section_key string")
    boosted = {r.item_id: r.section_boost for r in fusion.parent_boost(fused, hits).collect()}
    assert boosted == {"d:s1:0001": 1.0, "d:s2:0002": 1.08, "d:s2:o1:0003": 1.08}
    top = fusion.fused_top(fusion.without_boost(fused), 2).orderBy("pre_rank").collect()
    assert [r.item_id for r in top] == ["d:s1:0001", "d:s2:0002"]


def test_dense_blocks_and_ids(spark):
    vectors = spark.range(200).select(
        F.col("id").cast("string").alias("chunk_id"),
        F.array(F.sin("id"), F.cos("id"), F.col("id") % 7 + 0.5).cast("array<float>").alias("embedding"),
    )
    q = vectors.where("chunk_id < '2'").select(F.col("chunk_id").alias("query_id"), "embedding")
    key = lambda df: {(r.query_id, r.chunk_id, r.rank) for r in df.collect()}
    assert key(dense.cosine_topk(vectors, q, 5)) == key(dense.cosine_topk(vectors, q, 5, block_bytes=600))
    got = spark.range(1).select(dense.point_id(F.lit("M04:ch1:0001")).alias("p")).first().p
    assert got == str(uuid.uuid5(uuid.NAMESPACE_OID, "chunk:M04:ch1:0001"))


def test_order_statistics_and_numbering(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.pow(F.col("id") % 97, F.lit(3.0)).alias("v"), "id")
    for small in (200_000, 8, 0):
        found = nearest_rank(df, ["g"], "v", {"a": 0.5, "b": 0.95}, buckets=5, slice_rows=small)
        got = {r.g: (r.a, r.b) for r in found.collect()}
        for g in range(3):
            vs = sorted(float((i % 97) ** 3) for i in range(1000) if i % 3 == g)
            assert got[g] == tuple(vs[min(int(len(vs) * p), len(vs) - 1)] for p in (0.5, 0.95))
    n = numbered(df, ["g"], "id", "at", span=50).select("id", "at").collect()
    assert all(r.at == r.id // 3 + 1 for r in n)


def test_lookup_join_with_hot_key(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("k2999", 2), ("none", 3)], "k string, v int")
    got = lookup_join(big, small, ["k"], "id", "left", rows=100)
    assert got.count() == 3000 and got.where("v = 1").count() == 2500 and got.where("v = 2").count() == 1


def test_normal_form_and_domain_terms_on_both_sides(spark):
    rows = [("a", "die of 429mm² and ＨＢＭ４, ﬁne 先进封装 lines"), ("b", "nothing here")]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("n", normal_form(F.col("t")))
    known = F.array(F.lit("先进封装"))
    got = {r.id: r.x.split(" ") for r in df.select("id", lexical_text(F.col("n"), known).alias("x")).collect()}
    assert {"429mm2", "hbm4", "fine", "先进封装"} <= {w.lower() for w in got["a"]}
    chunks = df.select(
        "id", F.lit("").alias("heading_path"), F.lower(lexical_text(F.col("n"), known)).alias("lexical_text")
    )
    asked = spark.createDataFrame([(1, "429mm²"), (2, "ＨＢＭ４"), (3, "ﬁne"), (4, "先进封装")], "query_id int, query string")
    hits = lexical.search_terms(lexical.query_phrases(asked, known=known), lexical.term_index(chunks), 5)
    assert {(r.query_id, r.chunk_id) for r in hits.collect()} == {(q, "a") for q in (1, 2, 3, 4)}


def test_trie_takes_the_longest_terms(spark):
    listed = ["多层基板", "多层", "光学引擎", "引擎", "热管理方案", "a.b", "新方向"]
    trie = TermTrie(listed)
    text = "多层基板与光学引擎成为新方向，热管理方案决定成败，多层引擎"
    df = spark.createDataFrame([(text,), ("",), ("无关",)], "t string")
    got = [r.x for r in df.select(lexical_text(F.col("t"), trie).alias("x")).collect()]
    assert {"多层基板", "光学引擎", "热管理方案", "新方向", "多层", "引擎"} <= set(got[0].split(" ")) and "层基" not in got[0].split(" ")
    rnd = random.Random(1)
    words = {"".join(rnd.choice("甲乙丙") for _ in range(rnd.randint(2, 5))) for _ in range(12)}

    def longest(run):
        out, gap, i = [], "", 0
        while i <= len(run):
            best = max((w for w in words if run.startswith(w, i)), key=len, default=None) if i < len(run) else None
            if best or i == len(run):
                out += [gap] if 0 < len(gap) <= 2 else [gap[j : j + 2] for j in range(len(gap) - 1)]
                gap = ""
            if i == len(run):
                return out
            out += [best] if best else []
            gap += "" if best else run[i]
            i += len(best) if best else 1

    runs = ["".join(rnd.choice("甲乙丙丁") for _ in range(rnd.randint(1, 30))) for _ in range(200)]
    df = spark.createDataFrame([(r,) for r in runs], "t string")
    assert [r.x for r in df.select(terms(F.col("t"), TermTrie(words)).alias("x")).collect()] == [longest(r) for r in runs]
    df = spark.createDataFrame([("多层基板", False), ("HBM", True), ("光学引擎", False)], "term string, is_ascii boolean")
    assert lexical.domain_trie(df).pattern == TermTrie(["光学引擎", "多层基板"]).pattern
    with pytest.raises(ValueError):
        TermTrie(["字" * (TermTrie.MAX_CHARS + 1)])


def test_cosine_leaves_out_null_and_ragged_vectors(spark):
    v = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [0.0, 1.0]), ("e", [1.0, None]), ("f", [1.0, 2.0, 3.0])],
        "chunk_id string, embedding array<double>",
    )
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "query_id int, embedding array<double>")
    got = [(r.query_id, r.chunk_id, r.score) for r in dense.cosine_topk(v, q, 5).orderBy("rank").collect()]
    assert got == [(1, "a", 1.0), (1, "d", 0.0)]


def test_hot_keys_spread_without_losing_rows(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), "id")
    lookup = df.select("k").distinct().withColumn("v", F.col("k") * 2)
    out = lookup_join(df, lookup, ["k"], "id", rows=100)
    assert out.count() == 5000 and out.where("v <> 2 * k").count() == 0
    assert [r["_salts"] for r in hot_keys(df, ["k"], 100).collect()] == [40]


def test_scan_of_texts_equals_stored_trigrams(spark):
    chunks, asked = zipf_corpus(spark)
    # Copies tie, one text is null, and one phrase overlaps itself.
    copies = chunks.where("id < 40").select((F.col("id") + 1000).alias("id"), "plain_text", "heading_path")
    odd = spark.createDataFrame([(5000, None, ""), (5001, "w0w0w0 w1w1w1w1", "w2 head")], "id int, plain_text string, heading_path string")
    chunks = chunks.unionByName(copies).unionByName(odd)
    substrings = lexical.query_substrings(asked.unionByName(spark.createDataFrame([(95, "w1w1"), (96, "d_absent")], "query_id int, query string")))
    stored = lexical.gram_index(chunks, text_col="plain_text")
    scanned = lexical.GramIndex(None, stored.texts, stored.lengths)
    key = lambda df: {(r.query_id, r.chunk_id, r["rank"], round(r.score, 8)) for r in df.collect()}
    stored = lexical.GramIndex(staged(stored.grams), stored.texts, stored.lengths)
    assert key(lexical.search_substrings(substrings, scanned, 5)) == key(lexical.search_substrings(substrings, stored, 5))
    texts = chunks.select(F.col("id").alias("chunk_id"), "plain_text")
    wanted = spark.createDataFrame([(1, "w0 w1"), (2, "w"), (3, "w2"), (4, "W0"), (5, "w0 w1")], "query_id int, query string")
    pairs = lambda df: sorted(tuple(r) for r in df.collect())
    assert pairs(lexical.substring_truth(wanted, scanned, texts)) == pairs(lexical.substring_truth(wanted, stored, texts))
    words = spark.createDataFrame([(1, ["w7", "w0w0"]), (2, ["2", "w99"])], "query_id int, keywords array<string>")
    assert pairs(evaluation.keyword_truth(words, texts, scanned)) == pairs(evaluation.keyword_truth(words, texts, stored))


def test_registered_searches_keep_no_trigrams(spark):
    from fathomtext.registered import inputs

    assert inputs.lexical_index(spark, "/root/testdata/sf0.001")[1].grams is None
    assert set(inputs.lexical_tables(spark, "/root/testdata/sf0.001")) == {"postings", "term_lengths", "term_stats"}


def test_scan_of_words_equals_stored_postings(spark):
    from fathomtext.operators import lexical, scanning

    texts = ["Été, a-1 b a-1 a", "a 1 a", None, "", "...", "b" * 3 + " a 1", "a a a 1 1", "x y_z été"] + [f"w{i % 7} a{i % 3}-{i % 5} b" for i in range(60)]
    chunks = spark.createDataFrame([(i, "a" if i % 4 else None, t) for i, t in enumerate(texts)], "id long, heading_path string, t string")
    asked = spark.createDataFrame([("q1", "a a-1 b"), ("q2", "été a2-3 w5 zzz"), ("q3", "..."), ("q4", "a1-1 a1-2 a1-3 w1")], "query_id string, query string")
    phrases = lexical.query_phrases(asked)
    stored, scanned = lexical.term_index(chunks, text_col="t"), lexical.term_texts(chunks, text_col="t")
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in df.collect())
    want = key(lexical.search_terms(phrases, stored, 7))
    assert scanned.postings is None and len(want) == 21
    assert key(lexical.search_terms(phrases, scanned, 7)) == want
    assert key(lexical.ranked_by_score(lexical.pruned_terms(phrases, scanned.with_postings(), 7).scores, 7)) == want
    counts = {r.phrase: r.df for r in scanning.phrase_counts(phrases, scanned.texts, scanning.Words).collect()}
    hits = lexical.phrase_hits(phrases, stored)
    assert counts == {r.phrase: r["count"] for r in hits.groupBy("phrase").count().collect()}


def test_registered_searches_keep_no_postings(spark):
    from fathomtext.registered import inputs

    assert inputs.lexical_index(spark, "/root/testdata/sf0.001")[0].postings is None


def test_keyword_truth_travels_as_bits(spark):
    from fathomtext.operators import scanning

    # 150 queries need three numbers of bits; rows 3 and 4 share an id.
    asked = spark.createDataFrame([(q, f"k{q % 50:02d}") for q in range(150)], "query_id long, phrase string")
    texts = spark.createDataFrame(
        [(1, " ".join(f"k{i:02d}" for i in range(50))), (2, None), (3, "k01 k49"), (3, "k01 k02"), (4, "none")], "chunk_id long, plain_text string"
    )
    pairs = sorted(tuple(r) for r in scanning.distinct_holders(asked, texts).collect())
    want = [(q, 1) for q in range(150)] + [(q, 3) for q in range(150) if q % 50 in (1, 2, 49)]
    assert pairs == sorted(want) and sorted(tuple(r) for r in scanning.holders(asked, texts).distinct().collect()) == pairs


def test_only_the_texts_of_a_block_become_strings(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from fathomtext.operators import scanning

    monkeypatch.setattr(scanning, "BLOCK_CHARS", 10_000)
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i:05d}" * 1000 for i in range(2000)])], ["body"])
    known = scanning.Phrases(["00012", "x"])
    tracemalloc.start()
    start, stop, *_ = next(known.counts(batch, 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (start, stop) == (0, 2) and peak < 6_000_000
    assert sum(int(n[p == 0].sum()) for _, _, _, p, n, _ in known.counts(batch, 0)) >= 1000


def test_identifiers_start_where_a_run_starts(spark):
    """The same identifiers as a search from every place, in time that grows with a run, not with its square."""

    anywhere = text.IDENTIFIER.removeprefix(f"(?<!{text._C})")
    draw = random.Random(3)
    rows = [("".join(draw.choice("ab1+-/·.µ% :") for _ in range(draw.randint(0, 30))),) for _ in range(4000)]
    df = spark.createDataFrame(rows, "t string").select(
        text.identifiers(F.col("t")).alias("now"), F.array_distinct(F.regexp_extract_all("t", F.lit(anywhere), 0)).alias("before")
    )
    assert df.where("now <> before").count() == 0 and df.where("size(now) > 0").count() > 1000
    started = time.time()
    run = spark.range(1).select(text.identifiers(F.concat(F.repeat(F.lit("a"), 60000), F.col("id").cast("string"), F.lit(" a-1"))).alias("x"))
    assert run.selectExpr("size(x) AS n").collect()[0].n == 2
    plain = spark.range(1).select(text.identifiers(F.concat(F.repeat(F.lit("a"), 60000), F.lit(" a-1"))).alias("x"))
    assert plain.collect()[0].x == ["a-1"] and time.time() - started < 8
