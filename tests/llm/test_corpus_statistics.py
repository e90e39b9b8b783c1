"""Phrases, source divergence and personal data against brute force on small tables."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from fathomtext.llm import collocations, divergence, private_data
from fathomtext.llm.common import ranked
from fathomtext.llm.transducer import Transducer

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n bigint, rank int, score string, ord bigint, base string, key string"


def table(spark, rows):
    """Rows (doc_id, text, lang, source) with columns that clash with names the operators use."""
    return spark.createDataFrame([(*r, 1, 2, "s", 3, "b", "k") for r in rows], SCHEMA)


def corpus(seed=3, n=120):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdE") for _ in range(rnd.randint(1, 4))) for _ in range(40)] + ["né", "日本", "x y", "a-b"]
    phrase = ["alpha beta gamma", "alpha beta", "one two three four five six", "É né É né"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 50)):
            words.append(rnd.choice(phrase) if rnd.random() < 0.3 else rnd.choice(vocabulary))
            if rnd.random() < 0.1:
                words.append(rnd.choice([".", ", ", "\n", "\t", ";x", "!\r\n"]))
        rows.append((i, " ".join(words), ["en", "de", None, ""][i % 4], [f"s{i % 5}", None, ""][i % 3]))
    odd = [None, "", "  \n.", "a", "A b", "é" * 500, "ab " * 900, "\t\tx\ty..z"]
    rows += [(1000 + i, t, "en", "s1") for i, t in enumerate(odd)]
    rows += [rows[7], (None, rows[4][1], None, None), (None, None, "xx", "only"), (3000, "12 34", "yy", "a"), (3001, None, "yy", "b")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3).cache()


# --- phrases ---


def phrases_by_brute_force(rows, least, longest, top, percent):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f[lang][tuple(ws[i : i + m])] += 1
    out = set()
    for lang, counts in f.items():
        wanted = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in wanted.items():
            for w in range(2, len(p)):
                for s in range(len(p) - w + 1):
                    inside[p[s : s + w]] = max(inside[p[s : s + w]], a)
        scored = []
        for p, a in wanted.items():
            if 100 * inside[p] >= percent * a:
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


@pytest.mark.parametrize("least, longest, top, percent", [(4, 5, 2000, 100), (2, 3, 25, 60)])
def test_collocations(spark, docs, rows, least, longest, top, percent):
    got = collocations.collocations(docs, least, longest, top, percent)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.select(*names).collect()} == phrases_by_brute_force(rows, least, longest, top, percent)


def test_collocations_in_sparse_tiles(spark):
    # 6,000 words give ids far from the origin, where pairs are sorted coordinates.
    rnd = random.Random(5)
    common = [f"w{i}" for i in range(6000)]
    rows = [(0, ". ".join(" ".join(rnd.sample(common, 3)) for _ in range(200)), "en", "s")]
    rows += [(i, ". ".join(f"w{j} w{j + 1} w{(j * 7) % 6000}" for j in range(i, 5990, 3)), "en", "s") for i in range(1, 5)]
    got = collocations.collocations(table(spark, rows), 2, 3, 100_000)
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == phrases_by_brute_force(
        rows, 2, 3, 100_000, 100
    )


def test_tiles_and_coordinates_agree():
    rnd = np.random.default_rng(1)
    gi, gj = rnd.integers(0, 40_000, 50_000) // rnd.integers(1, 4000, 50_000), rnd.integers(0, 3000, 50_000)
    keys, a, b, times, place = collocations._count_block(gi, gj, 7)
    assert dict(zip(zip(a.tolist(), b.tolist()), times.tolist())) == collections.Counter(zip(gi.tolist(), gj.tolist()))
    assert (a[place] == gi).all() and (b[place] == gj).all()
    assert [k for k, _, _ in keys] == sorted({k for k, _, _ in keys}) and {k[0] for k, _, _ in keys} == {0, 1}
    total = collections.Counter()
    for (part, t1, t2, strip), lo, hi in keys:
        first, second = collocations._unpack_pairs((), *collocations._pack_pairs(part, a[lo:hi], b[lo:hi]))
        if second is None:
            cell = first + (strip << (collocations.TILE_BITS + collocations.STRIP_BITS))
            first, second = (t1 << 10) + (cell >> 10), (t2 << 10) + (cell & 1023)
        total.update(dict(zip(zip(first.tolist(), second.tolist()), times[lo:hi].tolist())))
    assert total == collections.Counter(zip(gi.tolist(), gj.tolist()))
    find = collocations._finder(a[:900], b[:900], np.arange(900))
    assert find(a[:1000], b[:1000]).tolist() == [*range(900), *[-1] * 100]


def test_packed_numbers():
    for top in (0, 1, 255, 256, 65_536, 1 << 32, (1 << 62) + 5):
        a = np.array([0, top, top // 2], np.int64)
        assert collocations.unpacked(collocations.packed(a)).tolist() == a.tolist()
    assert len(collocations.unpacked(collocations.packed(np.empty(0, np.int64)))) == 0


def test_ranked(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), rnd.randint(0, 30), i) for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "g string, v int, i int"), ["g"], ["v", "i"], "at").collect()
    for g in "ab":
        assert [(r["v"], r["i"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["at"])] == sorted(
            (v, i) for x, v, i in rows if x == g
        )
        assert sorted(r["at"] for r in got if r["g"] == g) == list(range(sum(x == g for x, _, _ in rows)))


# --- sources ---


def test_transducer():
    rnd = random.Random(6)
    keys = sorted({"".join(rnd.choice("abé日") for _ in range(rnd.randint(1, 7))).encode() for _ in range(800)})
    machine = Transducer(b"en\0" + k for k in keys)
    assert machine.n_keys == len(keys)
    # As many states as there are different sets of endings.
    endings = collections.defaultdict(set)
    for k in keys:
        for i in range(len(k) + 4):
            full = b"en\0" + k
            endings[full[:i]].add(full[i:])
    assert machine.n_states == len({frozenset(e) for e in endings.values()})
    asked = keys + [k + b"a" for k in keys[:50]] + [k[:-1] for k in keys[:200] if len(k) > 1] + [b"zz", b""]
    data = np.frombuffer(b"\n".join(asked), np.uint8)
    lengths = np.array([len(k) for k in asked])
    starts = np.append(0, np.cumsum(lengths + 1)[:-1])
    place = {k: i for i, k in enumerate(keys)}
    assert machine.ordinals(b"en\0", data, starts, lengths).tolist() == [place.get(k, -1) for k in asked]
    assert (machine.ordinals(b"de\0", data, starts, lengths) == -1).all()


def divergence_by_brute_force(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    df, c = collections.Counter(), collections.Counter()
    groups = collections.defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = term.findall((text or "").translate(LOWER))
        df.update({(lang, t) for t in found})
        c.update((lang, source, t) for t in found)
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for (x, t), n in df.items() if x == lang and n >= least), key=str.encode)
        share = lambda n, total: 1 + 1_000_000_000 * (n + 2) // (total + 2 * len(kept))
        far = lambda p, q: (p - q) ** 2 // (p + q)
        n = {s: sum(c[lang, s, t] for t in kept) for s in sources}
        q = {t: share(sum(c[lang, s, t] for s in sources), sum(n.values())) for t in kept}
        p = {s: {t: share(c[lang, s, t], n[s]) for t in kept} for s in sources}
        for s in sources:
            pairs = sorted((-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-far(p[s][t], q[t]), t.encode()) for t in kept if c[lang, s, t] and p[s][t] > q[t])
            for part, best in (("pair", pairs), ("term", terms[:top])):
                out |= {(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("least, top", [(10, 10), (1, 3)])
def test_divergence(spark, docs, rows, least, top):
    got = divergence.source_divergence(docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == divergence_by_brute_force(rows, least, top)


def test_divergence_over_many_shards_and_sources(spark):
    rnd = random.Random(9)
    terms = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(5000)]
    rows = [
        (i, " ".join(rnd.sample(terms, 60)) + " " + "same " * (i % 7), ["en", "de", "e"][i % 3], f"s{i % 140}" if i % 3 == 0 else f"s{i % 4}")
        for i in range(900)
    ]
    got = divergence.source_divergence(table(spark, rows), 1, 4).select("lang", "source", "part", "item", "value", "rank").collect()
    assert {tuple(r) for r in got} == divergence_by_brute_force(rows, 1, 4)


# --- personal data ---


def luhn(digits):
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def spans_by_brute_force(text):
    """The four patterns as they stand."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_patterns():
    rnd = random.Random(7)
    pieces = ["a@b.c", "@", "a.b@c", ".d", "1.2.3.4", "255", ".", "300.1.1.1", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+1 (555) 123-4567",
              "+", "0", "00", "+44.20", "é", "x%y@z-1.co.uk", "\n", "12", "007.1.2.3"]
    for _ in range(4000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14)))
        assert private_data.base_spans(text) == spans_by_brute_force(text), text


def test_patterns_take_time_in_proportion():
    for unit in ("a", "1", "1.", "1 ", "a@", "+1", "@", "a@b.", "((", "+1 ("):
        text = unit * (1_000_000 // len(unit))
        private_data.base_spans(text)
        private_data.marked_words(text)


def test_marginals_on_a_tree():
    rnd = np.random.default_rng(2)
    unary = rnd.normal(size=(6, 3))
    one, two = rnd.normal(size=(3, 3)), rnd.normal(size=(3, 3))
    edges = [(np.array([0, 1]), np.array([1, 2]), one), (np.array([1, 3, 3]), np.array([3, 4, 5]), two)]
    exact = np.zeros((6, 3))
    for y in itertools.product(range(3), repeat=6):
        score = sum(unary[i, y[i]] for i in range(6)) + sum(t[y[a], y[b]] for us, vs, t in edges for a, b in zip(us, vs))
        for i in range(6):
            exact[i, y[i]] += np.exp(score)
    exact /= exact.sum(axis=1, keepdims=True)
    assert np.allclose(private_data.marginals(unary, edges, 40), exact, atol=1e-6)


def card(rnd):
    body = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
    return next(body + d for d in "0123456789" if luhn(body + d))


def private_rows(n=150):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 40))]
        for datum in (card(rnd), f"{word()}.{word()}@{word()}.com", f"10.{i % 250}.3.4", f"+1 (555) 555-{1000 + i}"):
            if rnd.random() < 0.4:
                words.insert(rnd.randrange(len(words)), datum)
        for junk in (str(rnd.randint(1, 2000)), f"v{i}", "9" * rnd.randint(20, 30)):
            if rnd.random() < 0.3:
                words.insert(0, junk)
        rows.append((i, " ".join(words), "en", "s"))
    return rows


def test_personal_data(spark):
    rnd = random.Random(10)
    one, two = card(rnd), card(rnd)
    while luhn(one + two[:3]):
        one = card(rnd)
    rows = private_rows()
    apart = f"first {one} then later {one} {two} end"
    phone = "call +1 (826) 555-4081 190.137.223.20 now"
    plain = "in 1999 we saw 12 cats and 3,000 dogs v2 a1 b2"
    rows += [(500, apart, "en", "s"), (501, phone, "en", "s"), (502, plain, "en", "s"), (503, None, None, None), (504, "", "en", None), rows[3], (None, apart, "en", "s")]
    got = private_data.personal_data(table(spark, rows)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for (i, text, _, _) in rows:
        r = by_id[i]
        base = spans_by_brute_force(text or "")
        assert r["base"] == ",".join(f"{private_data.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert set(filter(None, r["base"].split(","))) <= set(filter(None, r["spans"].split(",")))
    # Two numbers in a row fail the check together; the first is known from elsewhere, the second by its form.
    at = apart.index(one, 20)
    assert f"card:{at}:{at + 16}" in by_id[500]["spans"].split(",")
    assert f"card:{at + 17}:{at + 33}" in by_id[500]["spans"].split(",")
    assert f"phone:5:{5 + len('+1 (826) 555-4081')}" in by_id[501]["spans"].split(",")
    assert by_id[502]["spans"] == "" and by_id[503]["spans"] == "" and by_id[504]["spans"] == ""
    assert {"lang", "source", "score"} <= set(got[0].asDict())


def test_like_words_share_a_label():
    shapes, checks = np.zeros((private_data.SHAPES, private_data.LABELS)), np.zeros((32, private_data.LABELS))
    shapes[:, 0] = 1.0
    skip = np.where(np.eye(private_data.LABELS) > 0, 2.0, -2.0)
    model = private_data.Model(shapes, checks, np.zeros((private_data.LABELS, private_data.LABELS)), skip)
    text = "4111 1111 1111 1111 and 41111111111111119 4111111111111111 x 4111111111111112"
    number = "4111111111111111"
    text = f"{number} far away {number} 77 then 4111111111111112"
    (base, every), = private_data.found_spans([text], model)
    assert base == [(0, 2, 16)]
    assert every == [(0, 2, 16), (26, 2, 42)]


def test_query_of_personal_data(spark, tmp_path):
    rows = private_rows(40)
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in private_data.op13_skip_chain_pii(spark, str(tmp_path)).collect()}
    for i, text, _, _ in rows:
        base = ",".join(f"{private_data.KINDS[k]}:{s}:{e}" for s, k, e in spans_by_brute_force(text))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_empty_tables(spark):
    none = table(spark, [])
    assert collocations.collocations(none).count() == 0
    assert divergence.source_divergence(none).count() == 0
    assert private_data.personal_data(none).count() == 0
    nothing = table(spark, [(1, None, None, None), (2, "", "en", "s"), (3, None, "en", "t")])
    assert collocations.collocations(nothing).count() == 0
    assert {tuple(r) for r in divergence.source_divergence(nothing).collect()} == {
        ("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)
    }
    assert [r["spans"] for r in private_data.personal_data(nothing).collect()] == [""] * 3
