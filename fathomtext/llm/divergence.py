"""How far the sources of a language differ in their words, and by which words.

The kept terms of all languages, sorted, are cut into shards.  Each shard becomes a minimal
acyclic transducer whose ordinals are the places of the terms in the whole list.  The texts
are then read again: a block of texts sends each shard the words of its range, and the
shard's transducer streams over them and counts by ordinal.  Ordinals stand for terms in all
later steps and break ties.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomtext.functions.stats import top_rows
from fathomtext.llm.common import UPPER, ranked, read_table, slices, written
from fathomtext.llm.transducer import Transducer

MIN_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000

# Bytes of UTF-8: letters in lower case and characters beyond ASCII stay, all others part terms.
_BYTES = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
BLOCK_CHARS = 8_000_000
#: Terms of a shard, and shards at most: their first terms are all that the driver and the tasks know of the list.
SHARD_TERMS, MAX_SHARDS = 2048, 4096
#: Terms and sources of one group of the comparison of sources.
PAIR_TERMS, PAIR_SOURCES = 8192, 128

FREQUENCIES = "key string, n bigint"
STREAM = "shard int, at bigint, key string, lang string, sources array<string>, sizes array<int>, terms binary, times binary"
COUNTS = "lang string, source string, ord bigint, c bigint"


def _key(lang: str, term: str) -> str:
    return f"{lang}\0{term}"


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))


# --- the vocabulary -------------------------------------------------------------------------


def _terms(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of the texts, all terms as places in that list, and the text that each stands in."""
    raw = [t.encode("utf-8").translate(_BYTES) for t in texts]
    lists = pc.split_pattern(pa.array(raw, pa.large_binary()), pattern=" ")
    found = lists.flatten().dictionary_encode()
    terms, codes = found.dictionary, found.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    gap = pc.index(terms, pa.scalar(b"", terms.type)).as_py()
    if gap >= 0:
        real = codes != gap
        codes, owner = codes[real], owner[real]
    return terms, codes, owner


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``key`` (language and term) with the number of documents that hold it, added up by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in slices(texts, BLOCK_CHARS):
                mine: dict[str, list[str]] = {}
                for lang, text in zip(langs[start:stop], texts[start:stop]):
                    if text:
                        mine.setdefault(lang, []).append(text)
                for lang, of_lang in mine.items():
                    terms, codes, owner = _terms(of_lang)
                    once = np.unique(owner * max(len(terms), 1) + codes) % max(len(terms), 1)
                    n = np.bincount(once, minlength=len(terms))
                    at = np.flatnonzero(n)
                    if len(at):
                        names = pc.binary_join_element_wise(_key(lang, ""), terms.take(pa.array(at)).cast(pa.large_string()).cast(pa.string()), "")
                        yield pa.RecordBatch.from_arrays([names, pa.array(n[at].astype(np.int64))], names=["key", "n"])

    return docs.select("lang", "text").mapInArrow(run, FREQUENCIES).groupBy("key").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Kept terms: ``key``, ``lang``, ``term`` and ``ord``, the place among all keys in UTF-8 order."""
    kept = document_frequencies(docs).where(F.col("n") >= min_documents).select("key")
    # Terms hold no zero character, languages may: the last one parts them.
    at = F.length("key") - F.length(F.substring_index("key", "\0", -1))
    return written(
        ranked(kept, [], [F.asc("key")], "ord").select(
            "key", "ord", F.left("key", at - 1).alias("lang"), F.substring_index("key", "\0", -1).alias("term")
        )
    )


# --- counting by transducer -------------------------------------------------------------------


def _packs(firsts: list[str]):
    """Rows (lang, source, text) to the terms of each block by shard: those of one source after the other."""
    bounds = [first.encode("utf-8") for first in firsts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = [f.split()[0] for f in STREAM.split(", ")]
        for batch in batches:
            langs, sources, texts = (batch.column(c).to_pylist() for c in range(3))
            for start, stop in slices(texts, BLOCK_CHARS):
                groups: dict[str, dict[str, list[str]]] = {}
                for lang, source, text in zip(langs[start:stop], sources[start:stop], texts[start:stop]):
                    if text:
                        groups.setdefault(lang, {}).setdefault(source, []).append(text)
                rows = []
                for lang, by_source in groups.items():
                    # The shards that may hold keys of this language, and where their ranges start among its terms.
                    prefix = _key(lang, "").encode("utf-8")
                    low = max(bisect_left(bounds, prefix) - 1, 0)
                    high = bisect_left(bounds, prefix[:-1] + b"\1")
                    cuts = [bounds[s][len(prefix) :] for s in range(low + 1, high)]
                    packs: list[list[tuple]] = [[] for _ in range(low, high)]
                    for source, mine in by_source.items():
                        terms, codes, _ = _terms(mine)
                        n = np.bincount(codes, minlength=len(terms)).astype(np.int64)
                        order = pc.array_sort_indices(terms).to_numpy()
                        order = order[n[order] > 0]
                        n, sorted_terms = n[order], terms.take(pa.array(order)).to_pylist()
                        starts = [0, *(bisect_left(sorted_terms, cut) for cut in cuts), len(sorted_terms)]
                        for pack, a, b in zip(packs, starts, starts[1:]):
                            if b > a:
                                pack.append((source, b - a, b"\n".join(sorted_terms[a:b]), n[a:b]))
                    for shard, pack in zip(range(low, high), packs):
                        if pack:
                            named, sizes, held, times = zip(*pack)
                            rows.append((shard, -1, None, lang, named, sizes, b"\n".join(held), np.concatenate(times).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _counted(limit: int = 2_000_000, waiting: int = 4_000_000):
    """Sorted shards, terms before packs, to counts; a shard's terms, ``waiting`` bytes of packs and ``limit`` counts in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, base, machine = None, [], 0, None
        counts: dict[tuple[str, str], np.ndarray] = {}
        packs: dict[str, list[tuple]] = {}
        held = 0

        def settled():
            for (lang, source), line in counts.items():
                at = np.flatnonzero(line)
                if len(at):
                    same = lambda v: pa.array([v], pa.string()).take(pa.array(np.zeros(len(at), np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [same(lang), same(source), pa.array(at + base), pa.array(line[at])], names=["lang", "source", "ord", "c"]
                    )
            counts.clear()

        def streamed():
            """All waiting packs through the transducer at once."""
            for lang, mine in packs.items():
                data = np.frombuffer(b"\n".join(terms for _, _, terms, _ in mine), np.uint8)
                times = np.concatenate([np.frombuffer(t, np.int64) for *_, t in mine])
                ends = np.append(np.flatnonzero(data == 10), len(data))
                starts = np.append(0, ends[:-1] + 1)
                ordinals = machine.ordinals(_key(lang, "").encode("utf-8"), data, starts, ends - starts)
                sizes = np.concatenate([np.array(s) for _, s, _, _ in mine])
                names, of = np.unique(np.array([n for named, *_ in mine for n in named], object), return_inverse=True)
                owner = np.repeat(of, sizes)
                hit = np.flatnonzero(ordinals >= 0)
                # Few sources at a time keep the sums small however many there are.
                for first in range(0, len(names), 64):
                    part = hit[(owner[hit] >= first) & (owner[hit] < first + 64)]
                    sums = np.zeros((min(64, len(names) - first), len(keys)), np.int64)
                    np.add.at(sums, (owner[part] - first, ordinals[part]), times[part])
                    for source, line in zip(names[first : first + 64], sums):
                        if (lang, source) in counts:
                            counts[lang, source] += line
                        else:
                            counts[lang, source] = line
                    if len(counts) * len(keys) > limit:
                        yield from settled()
            packs.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(8)]
            for s, at, key, lang, sources, sizes, terms, times in zip(*columns):
                if s != shard:
                    yield from streamed()
                    yield from settled()
                    shard, keys, machine, held = s, [], None, 0
                if key is not None:
                    if not keys:
                        base = at
                    keys.append(key.encode("utf-8"))
                    continue
                if not keys:
                    continue
                if machine is None:
                    machine = Transducer(keys)
                packs.setdefault(lang, []).append((sources, sizes, terms, times))
                held += len(terms)
                if held > waiting:
                    yield from streamed()
                    held = 0
        yield from streamed()
        yield from settled()

    return run


def term_counts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Occurrences of the kept terms by language and source, where there are any."""
    size = kept.agg(F.max("ord").alias("n")).first()["n"]
    per_shard = max(SHARD_TERMS, ((size or 0) + MAX_SHARDS) // MAX_SHARDS)
    firsts = [r["key"] for r in kept.where(F.col("ord") % per_shard == 0).orderBy("ord").select("key").collect()]
    texts = docs.select("lang", "source", "text").mapInArrow(_packs(firsts), STREAM)
    terms = kept.select(
        F.floor(F.col("ord") / per_shard).cast("int").alias("shard"), F.col("ord").alias("at"), "key",
        *(
            F.lit(None).cast(t).alias(c)
            for c, t in (("lang", "string"), ("sources", "array<string>"), ("sizes", "array<int>"), ("terms", "binary"), ("times", "binary"))
        ),
    )
    # Terms come first within a shard, in the order of their places; packs (-1) follow.
    stream = terms.unionByName(texts).withColumn("_last", F.col("key").isNull())
    dealt = stream.repartition("shard").sortWithinPartitions("shard", "_last", "at").drop("_last")
    return dealt.mapInArrow(_counted(), COUNTS).groupBy("lang", "source", "ord").agg(F.sum("c").alias("c"))


# --- comparing --------------------------------------------------------------------------------


def _share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 * (count + 2) / (total + 2 * terms))`` in decimals."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return (F.call_function("div", top, (total + 2 * terms).cast("decimal(19,0)")) + 1).cast("long")


def _difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _compare_sources(table: pa.Table) -> pa.Table:
    """One block of terms of two blocks of sources: the summed differences of each pair of sources.

    Rows with a null place give the share of a term that the source does not hold.
    """
    lang, pair = table.column("lang")[0].as_py(), [table.column(c)[0].as_py() for c in ("side_a", "side_b")]
    at = table.column("ord").fill_null(-1).to_numpy()
    p = table.column("p").to_numpy()
    numbers, column = np.unique(table.column("number").to_numpy(), return_inverse=True)
    none = at < 0
    held, cell = np.unique(at[~none], return_inverse=True)
    shares = np.zeros((len(numbers), len(held)), np.int64)
    absent = np.zeros(len(numbers), np.int64)
    absent[column[none]] = p[none]
    shares[:] = absent[:, None]
    shares[column[~none], cell] = p[~none]
    # Terms of the block that no source here holds differ in the same way for all of them.
    unheld = table.column("n_terms")[0].as_py() - len(held)
    side = numbers // PAIR_SOURCES
    out = []
    for a in np.flatnonzero(side == pair[0]):
        others = np.flatnonzero((side == pair[1]) & (numbers > numbers[a]))
        for some in np.array_split(others, max(1, len(others) // 16)):
            d = shares[some] - shares[a]
            apart = absent[some] - absent[a]
            values = (d * d // (shares[some] + shares[a])).sum(axis=1) + unheld * (apart * apart // (absent[some] + absent[a]))
            out.append((np.full(len(some), numbers[a]), numbers[some], values))
    a, b, value = (np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3))
    # Both directions of a pair have the same value.
    return pa.table(
        {"lang": pa.array([lang] * (2 * len(a)), pa.string()), "number": np.append(a, b).astype(np.int64),
         "other": np.append(b, a).astype(np.int64), "value": np.append(value, value).astype(np.int64)}
    )


def _pair_part(groups: DataFrame, shares: DataFrame, kept: DataFrame) -> DataFrame:
    """Every ordered pair of sources of a language with its value."""
    blocks = kept.groupBy("lang", F.floor(F.col("ord") / PAIR_TERMS).alias("block")).agg(F.count(F.lit(1)).alias("n_terms"))
    sides = groups.groupBy("lang").agg((F.floor(F.max("number") / PAIR_SOURCES) + 1).cast("int").alias("sides"))

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows repeated once for each block of sources that theirs is compared with."""
        side = F.floor(F.col("number") / PAIR_SOURCES).cast("int")
        return rows.join(sides, "lang").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select(
            "lang", "block", F.least(side, "_other").alias("side_a"), F.greatest(side, "_other").alias("side_b"), "number", "ord", "p"
        )

    absent = groups.join(blocks, "lang").select("lang", "block", "number", F.lit(None).cast("long").alias("ord"), "p0")
    present = shares.select("lang", F.floor(F.col("ord") / PAIR_TERMS).alias("block"), "number", "ord", "p")
    rows = dealt(absent.withColumnRenamed("p0", "p")).unionByName(dealt(present))
    rows = rows.join(blocks, ["lang", "block"])
    sums = rows.groupBy("lang", "block", "side_a", "side_b").applyInArrow(
        _compare_sources, "lang string, number bigint, other bigint, value bigint"
    )
    values = sums.groupBy("lang", "number", "other").agg(F.sum("value").alias("value"))
    mine = groups.select("lang", "source", "number")
    others = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("other"))
    every = mine.join(others, "lang").where("number <> other")
    return every.join(values, ["lang", "number", "other"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")
    )


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Ranked differences: each source to every other one of its language, and to the language by term.

    Defined cases: null text, language and source are empty strings; a group without kept terms takes part with the
    share of absent terms; a language without kept terms has value 0 for its pairs; equal values are ordered by
    item in UTF-8 order, terms by their ordinal; ids are not looked at, repeated rows count as often as they
    occur; a very long text is one block; an empty table gives no rows; other columns are ignored.
    """
    named = _named(docs)
    kept = vocabulary(named, min_documents)
    counts = written(term_counts(named, kept))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    every = named.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    groups = written(
        ranked(every, ["lang"], [F.asc("source")], "number")
        .join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        .select("lang", "source", "number", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
        .withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.greatest("v", F.lit(1)))))
    )
    shares = written(
        counts.join(groups, ["lang", "source"]).select(
            "lang", "source", "number", "ord", "c", _share(F.col("c"), F.col("n"), F.col("v")).alias("p")
        )
    )
    whole = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    of_lang = counts.groupBy("lang", "ord").agg(F.sum("c").alias("c")).join(whole, "lang")
    of_lang = of_lang.select("ord", _share(F.col("c"), F.col("n"), F.col("v")).alias("q"))
    above = shares.join(of_lang, "ord").where("p > q").select("lang", "source", "ord", _difference(F.col("p"), F.col("q")).alias("value"))
    best = top_rows(above, ["lang", "source"], [F.desc("value"), F.asc("ord")], top)
    term = best.join(kept.select("ord", F.col("term").alias("item")), "ord").select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank"
    )
    pairs = _pair_part(groups, shares, kept)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return pairs.withColumn("rank", F.row_number().over(order)).select(*term.columns).unionByName(term)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


#: Every kept term of every group is written out, counts of zero included.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (
  SELECT id, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCUMENTS}
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM d
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source) AS n
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, c, (1 + ({SCALE}::HUGEINT * (c + 2)) // (n + 2 * s.v))::BIGINT AS p
  FROM dense JOIN sizes s USING (lang)
), lang_counts AS (
  SELECT lang, term, sum(c) AS c FROM counts GROUP BY lang, term
), q AS (
  SELECT lang, term, (1 + ({SCALE}::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * s.v))::BIGINT AS q
  FROM lang_counts JOIN sizes s USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), rows AS (
  SELECT * FROM every
  UNION ALL
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value
  FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q
)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM rows QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
