"""The operators of the llm subpackage against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fathomtext.llm import (
    bpe, classifier, language_id, language_model, mixing, near_dup, passages, quality_rules, substrings, topk,
)
from fathomtext.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, block int, score string, ids string"


def table(spark, rows):
    """Documents with columns that clash with names the operators use."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", 7, "y", "z") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def corpus(seed=1, n=60):
    """Random texts with shared and edited passages, odd characters, nulls, ties and repeated rows."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(80)] + ["né", "日本", "Ab", "x-1"]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    shared = [line(rnd.randint(60, 120)) for _ in range(5)]
    rows = []
    for i in range(n):
        text = line(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 2)):
            ws = rnd.choice(shared).split()
            if rnd.random() < 0.4:
                ws[rnd.randrange(len(ws))] = "#"
            text += " " + " ".join(ws) + "\n" + line(rnd.randint(0, 30))
        rows.append((i, text, f"src{i % 4}" if i % 9 else None))
    odd = [None, "", "   \n", "a", "A b", "é" * 300, "ab" * 400, "x\ty\n\nx\ty\n\nx\ty", "<|endoftext|> don't  stop   x", rows[3][1]]
    rows += [(1000 + i, t, "src1") for i, t in enumerate(odd)]
    return [*rows, rows[5], (None, rows[4][1], "src0"), (None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def shingles(text, k):
    ws = WORD.findall((text or "").translate(LOWER))
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


# --- 1 ---


def test_topk(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1.5, 0.25, 0.5, 1.0, rnd.random()]) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6)]
    rows += [(None, rows[0][1]), rows[7], (400, [1.0]), (450, [2.0]), (304, rows[10][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors[i] = [math.floor(256 * x) for x in v]
    want = set()
    for q in vectors:
        if q % 50 == 0:
            found = [(-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
            want |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:5], 1)}
    got = topk.exact_topk(df, "vec_id", "embedding", F.col("id") % 50 == 0, 5, candidate_rows=40, query_rows=3)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.exact_topk(df.limit(0), "vec_id", "embedding", F.col("id") % 50 == 0).count() == 0


# --- 2 ---


def test_mixing(docs, rows, empty):
    got = mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "repeats").collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and free * weight[s] / w > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: 3 * sizes[s] if s in capped else free * weight[s] / w for s in order}
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(next(t or "" for i, t, s in rows if i == r["doc_id"] and s == r["source"])))
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["repeats"] <= 3
        taken[r["source"]] += r["repeats"] * r["size"]
    longest = max(len(WORD.findall(t or "")) for _, t, _ in rows)
    assert all(abs(taken[s] - want[s]) <= longest for s in order)
    again = mixing.mix_sources(docs.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "repeats").collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mix_sources(empty).count() == 0


# --- 3 ---


def test_bpe_equals_tiktoken(spark, docs, empty):
    tokenizer = bpe.public_tokenizer(spark)
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizer.value.ranks, special_tokens={})
    out = bpe.decode(bpe.encode(docs, tokenizer), tokenizer).select("doc_id", "text", "ids", "decoded", "lang").collect()
    assert len(out) == docs.count()
    for r in out:
        assert r["ids"] == oracle.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    hard = ["a  b   c\n\n d", " x", "x ", "it's we'll 'tis", "1234 5 678", "aaaaaaaaaaaaaaaa " * 50, "　x  y", "日本語テキスト", "🙂🙂 é", "\r\n\r\n z", "a  b", "q" * 5000]
    ids, counts = tokenizer.value.encode(hard)
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, t in enumerate(hard):
        assert ids[at[i] : at[i + 1]].tolist() == oracle.encode_ordinary(t), t
    assert bpe.token_digests(empty, tokenizer).count() == 0


def test_bpe_in_one_pass(spark, docs):
    """Ids and decoded bytes come from one Python pass; short and long pre-tokens are merged alike."""
    tokenizer = bpe.public_tokenizer(spark)
    once = bpe.round_trip(docs, tokenizer)
    assert "text" not in once.columns
    twice = bpe.decode(bpe.encode(docs, tokenizer), tokenizer).select(*once.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, once.collect())) == sorted(map(key, twice.collect()))
    plan = bpe.token_digests(docs, tokenizer)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    draw = np.random.default_rng(1)
    for n in [1, 2, 3, bpe.SHORT, *draw.integers(1, bpe.SHORT, 500)]:
        piece = bytes(draw.choice(np.frombuffer(b"aaaeinrst th\xc3\xa9", np.uint8), n).tolist())
        assert tokenizer.value.scanned(piece) == tokenizer.value.heaped(piece)


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.owner.tolist()) == list(range(5000))
    assert table.candidates(keys).tolist() == list(range(5000))


# --- 4 and 6 ---


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = classifier.op4_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    held = out.where("held_out").collect()
    assert len(held) > 100 and sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out.collect())


def test_classifier_reads_whole_words():
    long = "a" * 70
    shapes = {classifier._features_of(w)[1] for w in (long, long + "7", long + "7-", long + "日本")}
    assert len(shapes) == 4
    assert classifier._features_of("b" * 9)[1] == classifier._features_of(long)[1]


def test_classifier_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = classifier.fitted(docs, labels, "quality", F.lit(True), 5)
    assert len(model.labels) == 10
    out = classifier.scored(docs, model)
    assert out.count() == docs.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    none = classifier.fitted(docs, labels.limit(0), "quality", F.lit(True))
    assert {r["score"] for r in classifier.scored(docs, none).collect()} == {0.5}
    assert classifier.scored(empty, model).count() == 0


def test_language_id(spark):
    sf = "/root/testdata/sf0.01"
    pages, docs = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id.identify(pages, docs).join(pages.select("page_id", F.regexp_extract("url", "//[^/]*/([a-z]+)/", 1).alias("want")), "page_id")
    assert out.where("lang = want").count() >= 0.99 * pages.count()
    odd = spark.createDataFrame(
        [(1, None, None, "a"), (2, "nonsense", "", "b"), (None, "http://h.example.de/x", "<html lang=de><p>und die der", "c"), (2, "nonsense", "", "b")],
        "page_id long, url string, html string, host string",
    )
    got = language_id.identify(odd, docs).collect()
    assert len(got) == 4 and all(r["lang"] for r in got)
    assert language_id.identify(odd.limit(0), docs).count() == 0
    assert {r["lang"] for r in language_id.identify(odd, docs.limit(0)).collect()} == {None}


# --- 5 ---


def test_quality_rules(docs, rows, empty):
    got = collections.Counter(
        (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        for r in quality_rules.quality_rules(docs).collect()
    )
    want = collections.Counter()
    for i, t, _ in rows:
        t = t or ""
        ws, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        where = collections.defaultdict(list)
        for k in range(len(ws) - 4):
            where[tuple(ws[k : k + 5])].append(k)
        covered = {p for v in where.values() if len(v) > 1 for k in v for p in range(k, k + 5)}
        failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
        want[(i, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)] += 1
    assert got == want
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_keep_good_and_reject_bad(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_rules.op5_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good, bad = [r["kept"] for r in out if r["quality"]], [r["kept"] for r in out if not r["quality"]]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


# --- 7 ---


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark, empty):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows, current = [], base
    for i in range(90):
        if i % 30 == 0:
            current = [f"w{rnd.randrange(500)}" for _ in range(120)]
        ws = list(rnd.choice([current, base]))
        for _ in range(rnd.randint(0, 3)):
            ws[rnd.randrange(len(ws))] = f"v{rnd.randrange(99)}"
        current = ws
        rows.append((i, " ".join(ws).title() if i % 5 == 0 else " ".join(ws), "s"))
    rows += [(500 + i, t, "s") for i, t in enumerate([None, "", " ", "a", "A", "a b", "a  B", "a b c", "a b c d"])]
    rows += [rows[4], (None, rows[2][1], "s")]
    for k, percent in ((3, 85), (5, 80)):
        sets = {i: shingles(t, k) for i, t, _ in rows if i is not None}
        comp = {i: i for i in sets}
        changed = True
        while changed:
            changed = False
            for i, x in sets.items():
                for j, y in sets.items():
                    if x and y and comp[i] < comp[j] and 100 * len(x & y) >= percent * len(x | y):
                        comp[j], changed = comp[i], True
        got = near_dup.near_duplicates(table(spark, rows), k, percent).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is not None:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_an_id_with_two_texts(spark):
    rnd = random.Random(11)
    a, b = ([f"w{rnd.randrange(10_000)}" for _ in range(200)] for _ in range(2))
    near = lambda ws: " ".join([*ws[:100], "#", *ws[100:]])
    apart = " ".join(f"x{rnd.randrange(10_000)}" for _ in range(200))
    for texts in ((a, b), (b, a)):
        first, second = map(" ".join, texts)
        rows = [(5, first, "s"), (5, second, "s"), (6, near(a), "s"), (7, near(b), "s"), (1, second, "s"), (8, apart, "s")]
        got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(table(spark, rows)).collect()}
        assert got == {5: 1, 6: 1, 7: 1, 1: 1, 8: 8}


# --- 8 ---


def test_backoff_automaton(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(language_model, "RANGE_ENTRIES", 300)
    trained = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t, _ in rows]
    use = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _, _ in rows]
    one = collections.Counter(w for t, u in zip(tokens, use) if u for w in t)
    two = collections.Counter(p for t, u in zip(tokens, use) if u for p in zip(["\0", *t], t))
    n, v, b = sum(one.values()), len(one), language_model.BACKOFF_WEIGHT
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    h = lambda u: sum(use) if u == "\0" else one[u]
    want = collections.Counter()
    for (i, _, _), t in zip(rows, tokens):
        base = sum(math.log10(p1(w)) for w in t)
        score = sum(math.log10((two[(u, w)] + b * p1(w)) / (h(u) + b)) for u, w in zip(["\0", *t], t))
        want[(i, len(t), sum(one[w] > 0 for w in t), n, round(base, 6), round(score, 6))] += 1
    got = language_model.language_model_scores(docs, trained).collect()
    assert collections.Counter(
        (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got
    ) == want
    assert language_model.language_model_scores(empty, trained).count() == 0
    assert all(r["base_score"] == 0 for r in language_model.language_model_scores(docs, F.lit(False)).where("n_tokens = 1").collect())


# --- 9 ---


@pytest.mark.parametrize("pieces", [4000, 20])
def test_repeated_bytes(spark, docs, rows, empty, monkeypatch, pieces):
    monkeypatch.setattr(substrings, "SHARD_PIECES", pieces)
    width = 200
    # Every row is a document, the repeated row and the copy without an id too.
    raw = {k: (t or "").encode() for k, (_, t, _) in enumerate(rows)}
    count = collections.Counter(b[p : p + width] for b in raw.values() for p in range(len(b) - width + 1))
    want = {}
    for k, b in raw.items():
        mark = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if count[b[p : p + width]] > 1:
                mark[p : p + width] = b"\1" * width
        kept = bytes(c for c, m in zip(b, mark) if not m)
        want[k] = (len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    assert sum(w[1] > 0 for w in want.values()) > 20
    monkeypatch.setattr(substrings, "read_table", lambda s, d, n: docs)
    got = substrings.op9_suffix_array_dedup(spark, "").collect()
    assert sorted((r["doc_id"] or -1, *tuple(r)[1:]) for r in got) == sorted((i or -1, *want[k]) for k, (i, _, _) in enumerate(rows))
    monkeypatch.setattr(substrings, "read_table", lambda s, d, n: empty)
    assert substrings.op9_suffix_array_dedup(spark, "").count() == 0


def test_suffix_array_and_prefixes():
    from fathomtext.llm.suffixes import common_prefixes, joined, suffix_array

    pieces = [b"banana" * 9, b"", b"ananas", b"banana" * 9, b"\0\0\0\0\0\0\0\0\0x"]
    data, owner, rest = joined(pieces)
    sa = suffix_array(data, rest)
    text = lambda i: (pieces[owner[i]][len(pieces[owner[i]]) - rest[i] :], owner[i])
    assert [text(i) for i in sa] == sorted(map(text, range(len(data))))
    prefix = common_prefixes(data, rest, sa, 30, stripe=7)
    for k in range(1, len(sa)):
        a, b = text(sa[k - 1])[0], text(sa[k])[0]
        n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
        assert prefix[k] == min(n, 30)


def test_long_text_in_parts():
    rnd = np.random.default_rng(1)
    raw = bytes(rnd.integers(97, 101, 9000, dtype=np.uint8))
    whole = np.frombuffer(raw, np.uint8)
    places, h = substrings.anchors(whole, np.array([0]), np.array([len(raw)]), 200)
    got = []
    for offset, part, lo, hi in substrings._parts(raw, 200, most=1500):
        p, _ = substrings.anchors(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]), 200)
        got += [int(x) + offset for x in p if lo <= x < hi]
    assert got == places.tolist()


# --- 10 ---


def test_shared_passages(spark, empty):
    rnd = random.Random(4)
    fresh = lambda n: [f"u{rnd.randrange(10**6)}" for _ in range(n)]
    passage = fresh(90)
    edited = list(passage)
    edited[30], edited[60] = "x", "y"
    del edited[45]
    texts = [
        fresh(40) + passage + fresh(20), fresh(10) + passage + fresh(50), fresh(70) + edited, fresh(200),
        fresh(30) + passage[:40] + fresh(30), passage, [], ["a"],
    ]
    rows = [(i, " ".join(t) if i else " ".join(t).upper(), "s") for i, t in enumerate(texts)] + [(50, None, "s"), (None, " ".join(passage), "s")]
    rows.append(rows[3])
    docs = table(spark, rows)
    found = passages.shared_passages(docs)
    got = {r["doc_id"]: r for r in found.collect()}
    assert set(got) == {1, 2, 5} and all(r["owner_id"] == 0 for r in got.values())
    assert (got[1]["lo"], got[1]["hi"], got[5]["lo"], got[5]["hi"]) == (10, 100, 0, 90)
    assert (got[2]["lo"], got[2]["hi"], got[2]["equal_words"]) == (70, 159, 87)
    left = {r["doc_id"]: r for r in passages.without_passages(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), found).collect()}
    assert set(left) == {0, 1, 2, 3, 4, 6, 7, 50}
    assert left[1]["text"].split() == texts[1][:10] + texts[1][100:] and left[1]["n_chars"] == len(left[1]["text"])
    assert left[2]["text"].split() == texts[2][:70] and left[3]["text"] == rows[3][1] and left[50]["text"] is None
    assert passages.shared_passages(empty).count() == 0
    assert passages.without_passages(docs, found.limit(0)).count() == docs.count()


def test_chains_follow_the_best_order():
    x = np.array([0, 5, 10, 15, 20, 25, 12, 18])
    y = np.array([100, 105, 110, 115, 121, 126, 5, 300])
    (first, *rest) = passages.chains(x, y)
    assert first == (0, 25, 100, 126, 6) and not rest


def test_passages_of_finds_the_longest_stretches():
    assert passages.passages_of([(0, 0, 25), (35, 35, 25)], 50, 80) == [(0, 60, 0, 60, 50)]
    # A better scored run that is too short hides none beside it.
    runs = [(0, 0, 49), (200, 200, 18), (220, 220, 18), (242, 242, 18)]
    assert passages.passages_of(runs, 50, 80) == [(200, 260, 200, 260, 54)]
    rnd = random.Random(8)
    for _ in range(300):
        runs, i, j = [], 0, 0
        for _ in range(rnd.randint(0, 8)):
            n = rnd.randint(1, 30)
            runs.append((i, j, n))
            i, j = i + n + rnd.randint(1, 8), j + n + rnd.randint(1, 8)
        fits = []
        for s in range(len(runs)):
            for t in range(s, len(runs)):
                total = sum(r[2] for r in runs[s : t + 1])
                for p, q in zip(runs[s:t], runs[s + 1 : t + 1]):
                    total -= 4 * max(q[0] - p[0] - p[2], q[1] - p[1] - p[2])
                size = max(runs[t][k] + runs[t][2] - runs[s][k] for k in (0, 1))
                if total >= 0 and size >= 50:
                    fits.append((size, runs[s][0], runs[t][0] + runs[t][2]))
        got = passages.passages_of(runs, 50, 80)
        assert bool(got) == bool(fits)
        assert max((max(g[1] - g[0], g[3] - g[2]) for g in got), default=0) == max(fits, default=(0,))[0]
        # Every stretch that fits has a passage in it or across its ends.
        assert all(any(g[0] < hi and lo < g[1] for g in got) for _, lo, hi in fits)


def test_shared_passages_go_on_after_a_gap(spark):
    rnd = random.Random(9)
    fresh = lambda n: [f"u{rnd.randrange(10**6)}" for _ in range(n)]
    opening, closing = fresh(400), fresh(300)
    texts = [opening + closing, opening + fresh(300) + closing, opening + fresh(400) + closing]
    docs = table(spark, [(i, " ".join(t), "s") for i, t in enumerate(texts)])
    got = sorted((r["doc_id"], r["lo"], r["hi"]) for r in passages.shared_passages(docs).collect())
    covered = collections.defaultdict(set)
    for doc, lo, hi in got:
        covered[doc] |= set(range(lo, hi))
    assert set(covered) == {1, 2}
    assert covered[1] >= {*range(400), *range(700, 1000)} and covered[2] >= {*range(400), *range(800, 1100)}


def test_all_holders_of_a_common_seed_meet(spark):
    """A line that many documents hold, in passages of few of them: each pair is found, whatever its place among the holders."""
    rnd = random.Random(31)
    fresh = lambda n: [f"u{rnd.randrange(10**9)}" for _ in range(n)]
    line = fresh(12)
    full = {i: fresh(70) + line + fresh(70) for i in range(80)}
    want = set()
    for n in range(8):
        # Runs of four words beside the line, behind another word, are no seeds: only the line leads to the passage.
        left, right = fresh(24), fresh(24)
        for i in (20 + n, 50 + n):
            marked = lambda ws: [w if j % 5 else fresh(1)[0] for j, w in enumerate(ws)]
            full[i] = fresh(50 + n) + [*reversed(marked(left))] + line + marked(right) + fresh(40)
        want.add((50 + n, 20 + n))
    docs = table(spark, [(i, " ".join(t), "s") for i, t in full.items()])
    found = passages.shared_passages(docs).collect()
    assert {(r["doc_id"], r["owner_id"]) for r in found} == want
    assert all(r["hi"] - r["lo"] == r["owner_hi"] - r["owner_lo"] >= 50 and r["equal_words"] >= 48 for r in found)


def test_pairs_of_one_run_are_chained_alike():
    rnd = random.Random(6)
    pair = lambda x, y: (x << 32) | y
    rows, want = [], []
    for i in range(200):
        x, y, n = rnd.randrange(90), rnd.randrange(90), rnd.randint(1, 40)
        ones = [pair(x + j, y + j) for j in range(n)]
        if i % 3 == 0:
            ones.append(pair(x + n + rnd.randint(0, 2), y + n + rnd.randint(0, 2)))
        rnd.shuffle(ones)
        rows.append((i, 7, ones, [{"place": 3, "again": None, "owner_place": 3, "owner_again": [9]}] if i % 7 == 0 else []))
        xs, ys = ([o >> 32 for o in ones] + [3, 3, 3][: 3 * (i % 7 == 0)], [o & 0xFFFFFFFF for o in ones] + [3, 3, 9][: 3 * (i % 7 == 0)])
        for p, q in passages.paths(*passages.thinned(np.array(xs), np.array(ys))):
            lo, owner_lo = max(0, p[0] - 50), max(0, q[0] - 50)
            anchors = np.array([[v - lo for v in p], [v - owner_lo for v in q]], np.int32).tobytes()
            want.append((i, 7, lo, p[-1] + 55, owner_lo, q[-1] + 55, anchors))
    spot = pa.struct([("place", pa.int32()), ("again", pa.list_(pa.int32())), ("owner_place", pa.int32()), ("owner_again", pa.list_(pa.int32()))])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(spot)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc", "owner", "ones", "spots"])
    got = [tuple(r.values()) for b in passages._chained([batch], 5, 50) for r in b.to_pylist()]
    assert sorted(got) == sorted(want) and len(got) > 100


def test_no_passage_is_left_out_by_its_words():
    """Stretches with a passage pass the counts of words, at every shift of the windows."""
    from fathomtext.llm import holders

    spans = holders.windows(50, 80)
    before, behind = -min(s[0] for s in spans), max(s[1] for s in spans)
    rnd = np.random.default_rng(5)
    kept = 0
    for trial in range(400):
        n = int(rnd.integers(50, 180))
        word = lambda m: rnd.integers(1, 2**62, m).astype(np.uint64)
        a = word(n)
        rows = []
        for w in a:
            act = rnd.random() if rnd.random() < 0.3 else 1.0
            rows.append(word(1) if act < 0.4 else word(0) if act < 0.6 else np.concatenate([[w], word(1)]) if act < 0.8 else np.array([w]))
        b = np.concatenate(rows)
        at, place = np.intersect1d(a, b, return_indices=True)[1:]
        order = np.argsort(at)
        at, place = at[order], place[order]
        runs, start = [], 0
        for t in range(1, len(at) + 1):
            if t == len(at) or (at[t], place[t]) != (at[t - 1] + 1, place[t - 1] + 1):
                runs.append((int(at[start]), int(place[start]), t - start))
                start = t
        if not passages.passages_of(runs, 50, 80) or max(r[2] for r in runs) < 5:
            continue
        kept += 1
        a, b = np.concatenate([word(70), a, word(70)]), np.concatenate([word(90), b, word(60)])
        assert passages.possible(a, b, 50, 80)
        codes = lambda x: np.concatenate([np.zeros(before, np.uint16), (x % np.uint64(65535)).astype(np.uint16) + np.uint16(1), np.zeros(behind, np.uint16)])
        met = False
        for i, j, size in runs:
            if size >= 5:
                p, q = i + 70, j + 90
                met |= bool(holders.close(codes(a)[None, p : p + before + behind], codes(b)[None, q : q + before + behind], spans, before)[0, 0])
        assert met
    assert kept > 50


def test_alignment_meets_every_seed():
    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:300], rnd.integers(0, 2**63, 500).astype(np.uint64), a[300:]])
    x = np.array([10, 200, 310, 800])
    y = np.array([10, 200, 810, 1300])
    assert passages.aligned(a, b, x, y, 5) == [(0, 0, 300), (300, 800, 600)]


def changed_pairs(rnd, each):
    """Pairs of texts with a 60-word passage: (changed words in 60, text, other text, the longest passage by brute force)."""
    fresh = lambda n: [f"u{rnd.randrange(10**9)}" for _ in range(n)]
    for changes in [0, 3, 6, 9, 12, "every 12th", "every 6th"]:
        for _ in range(each):
            passage = fresh(60)
            places = range(11, 60, 12) if changes == "every 12th" else range(5, 60, 6) if changes == "every 6th" else rnd.sample(range(60), changes)
            other = list(passage)
            for i in places:
                other[i] = fresh(1)[0]
            same = [a == b for a, b in zip(passage, other)]
            longest = max((hi - lo for lo in range(11) for hi in range(lo + 50, 61) if sum(same[lo:hi]) * 5 >= 4 * (hi - lo)), default=0)
            yield changes, fresh(80) + passage + fresh(80), fresh(90) + other + fresh(70), longest


def test_shared_passages_recall(spark):
    cases = list(changed_pairs(random.Random(12), 40))
    texts = [t for _, a, b, _ in cases for t in (a, b)]
    docs = table(spark, [(i, " ".join(t), "s") for i, t in enumerate(texts)])
    found = {r["doc_id"]: r for r in passages.shared_passages(docs).collect()}
    assert all(i % 2 and r["owner_id"] == i - 1 for i, r in found.items())
    want, got = collections.Counter(), collections.Counter()
    for n, (changes, _, _, longest) in enumerate(cases):
        assert longest or 2 * n + 1 not in found
        want[changes] += longest > 0
        got[changes] += longest > 0 and 2 * n + 1 in found
    print("recall", {c: f"{got[c]}/{want[c]}" for c in want})
    for changes in want:
        assert got[changes] >= (0.95 if changes == 12 else 1) * want[changes], (changes, got, want)


def test_shared_passages_with_split_owners(spark):
    rnd = random.Random(21)
    fresh = lambda n: [f"u{rnd.randrange(10**9)}" for _ in range(n)]
    passage, second, third = fresh(60), fresh(60), fresh(60)
    texts = {1: passage[:30], 2: passage[30:], 5: passage, 6: passage[:30], 7: passage[30:], 9: passage}
    # More holders of each half than meet one by one, and of a half with a changed word at the joint.
    texts |= {100 + i: (second[:30] if i % 2 else second[30:]) for i in range(60)}
    texts |= {200: second[:30] + fresh(1) + second[30:], 201: second[:30] + fresh(1) + second[30:]}
    # The owner quotes part of the passage before.
    texts |= {300: third[:28] + fresh(70) + third, 301: third}
    full = {i: fresh(60) + t + fresh(60) for i, t in texts.items()}
    # A whole text that is a line repeated, and one that repeats it more often.
    line = fresh(12)
    full |= {400: line * 90, 401: line * 200}
    docs = table(spark, [(i, " ".join(t), "s") for i, t in full.items()])
    found = passages.shared_passages(docs).collect()
    got = {(r["doc_id"], r["owner_id"], r["lo"], r["hi"]) for r in found if r["doc_id"] < 400}
    assert got == {(9, 5, 60, 120), (201, 200, 60, 121), (301, 300, 60, 120)}
    covered = {w for r in found if r["doc_id"] == 401 for w in range(r["lo"], r["hi"])}
    assert covered == set(range(12 * 200)) and all(r["owner_id"] == 400 for r in found if r["doc_id"] == 401)
