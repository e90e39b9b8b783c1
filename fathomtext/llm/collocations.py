"""Phrases whose words occur together more often than their parts suggest, by direct-address tiling.

Words that are frequent enough get ids in the order of their frequency.  The square of all
pairs of ids is cut into tiles of 1,024 by 1,024; tiles near the origin, where frequent ids
meet, are counted by ``numpy.bincount`` over their cells, the others as sorted coordinates.
Frequent pairs are ranked again and take the place of words: a phrase of ``m + 1`` words is
a pair of overlapping phrases of ``m`` words, so the same counting runs up to the longest
phrase.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fathomtext.functions.stats import top_rows
from fathomtext.llm.common import UPPER, discard, ranked, read_table, slices, written

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
INSIDE_PERCENT = 100

TILE_BITS = 10
#: Rows of a dense tile that are added up in one place.
STRIP_BITS = 7
#: A tile (i, j) is dense if (i + 1) * (j + 1) is at most this; the rule knows ids only, so all blocks agree.
DENSE = 16
#: Words of the table for each bucket of sparse pairs, which bounds the pairs of a bucket on average.
WORDS_PER_BUCKET = 16_000_000
BLOCK_CHARS = 16_000_000

_CELLS = 1 << (2 * TILE_BITS)
_STRIP_CELLS = 1 << (TILE_BITS + STRIP_BITS)
_LOW = (1 << TILE_BITS) - 1
# Bytes of UTF-8: A-Z in lower case, ends of pieces as line ends, tabs as spaces.
_BYTES = bytes.maketrans(UPPER.encode() + b".,;:!?\x0B\x0C\r\t", UPPER.lower().encode() + b"\n" * 9 + b" ")
_ENDS = re.compile(rb"\n+")

#: Bytes of text for each bucket of words, which bounds the distinct words of a bucket on average.
BYTES_PER_BUCKET = 12_000_000
BLOCKS = "block string, lang string, bucket int, words binary, local binary, counts binary, n bigint, codes binary"
WORDS = "lang string, bucket int, word string, a bigint"
KEY = ["lang", "part", "t1", "t2", "strip"]
DEALT = "lang string, part int, t1 bigint, t2 bigint, strip int"
PAIRS = f"block string, {DEALT}, base bigint, at binary, other binary, times binary, codes binary"
COUNTED = f"{DEALT}, gi bigint, gj bigint, a bigint"
MAPPED = "block string, local binary, gid binary"


# --- packed numbers -------------------------------------------------------------------------


def packed(a: np.ndarray) -> bytes:
    """Non-negative numbers in the narrowest type that holds them, compressed."""
    top = int(a.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - (w == 8)))
    raw = a.astype(f"<u{width}").tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(b: bytes) -> np.ndarray:
    size = int.from_bytes(b[1:9], "little")
    return np.frombuffer(pa.decompress(b[9:], size, "zstd", asbytes=True), f"<u{b[0]}").astype(np.int64)


# --- blocks of words ----------------------------------------------------------------------


def _coded(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts by falling frequency, their counts, and the texts as places in that list; -1 ends a piece."""
    data = _ENDS.sub(b" \n ", "\n".join(texts).encode("utf-8").translate(_BYTES))
    tokens = pc.split_pattern(pa.array([data], pa.large_binary()), pattern=" ").values.dictionary_encode()
    found, codes = tokens.dictionary, tokens.indices.to_numpy()
    counts = np.bincount(codes, minlength=len(found))
    marks = {b"": -2, b"\n": -1}
    at = {mark: pc.index(found, pa.scalar(mark, found.type)).as_py() for mark in marks}
    for mark, i in at.items():
        if i >= 0:
            counts[i] = 0
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    place = np.empty(len(found), np.int32)
    place[order] = np.arange(len(order))
    for mark, i in at.items():
        if i >= 0:
            place[i] = marks[mark]
    codes = place[codes]
    return found.take(pa.array(order)), counts[order], codes[codes != -2]


def _pack_words(words: list[bytes]) -> bytes:
    raw = b"\n".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack_words(b: bytes) -> list[bytes]:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True).split(b"\n")


def word_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """The texts as blocks of word codes of one language each, and the words of each block by bucket of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in slices(texts, BLOCK_CHARS):
                mine: dict[str, list[str]] = {}
                for lang, text in zip(langs[start:stop], texts[start:stop]):
                    if text:
                        mine.setdefault(lang, []).append(text)
                for lang, of_lang in mine.items():
                    found, counts, codes = _coded(of_lang)
                    words, block = found.to_pylist(), uuid.uuid4().hex
                    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
                    order = np.argsort(bucket, kind="stable")
                    rows = [
                        (block, lang, int(bucket[order[a]]), _pack_words([words[i] for i in order[a:b]]), packed(order[a:b]),
                         packed(counts[order[a:b]]), None, None)
                        for a, b in _runs(bucket[order])
                    ]
                    rows.append((block, lang, *[None] * 4, int(counts.sum()), packed(codes + 1)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, BLOCKS)


def _add_words(min_count: int):
    """Sorted buckets of words to the words that occur often enough, one bucket in memory."""

    def settled(key, counts):
        often = [(w, n) for w, n in counts.items() if n >= min_count]
        words, a = zip(*often) if often else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * len(a), pa.string()), pa.array([key[1]] * len(a), pa.int32()),
             pa.array(words, pa.binary()).cast(pa.string()), pa.array(a, pa.int64())],
            names=["lang", "bucket", "word", "a"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, {}
        for batch in batches:
            for lang, bucket, words, n in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if (lang, bucket) != now:
                    if now is not None:
                        yield settled(now, counts)
                    now, counts = (lang, bucket), {}
                for word, times in zip(_unpack_words(words), unpacked(n).tolist()):
                    counts[word] = counts.get(word, 0) + times
        if now is not None:
            yield settled(now, counts)

    return run


def _resolved_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted buckets, the ids of a bucket's frequent words before its packs, to the ids of each block's words."""
    now, known = None, {}
    for batch in batches:
        out = []
        for lang, bucket, block, words, local, names, gids in zip(*(batch.column(c).to_pylist() for c in range(7))):
            if block is None:
                now, known = (lang, bucket), {w.encode("utf-8"): g for w, g in zip(names, gids)}
                continue
            if (lang, bucket) != now:
                continue
            ids = np.array([known.get(w, -1) for w in _unpack_words(words)], np.int64)
            hit = np.flatnonzero(ids >= 0)
            if len(hit):
                out.append((block, packed(unpacked(local)[hit]), packed(ids[hit])))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.binary()))], names=["block", "local", "gid"]
            )


# --- counting pairs in tiles ----------------------------------------------------------------


def _tile(gi: np.ndarray, gj: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return gi >> TILE_BITS, gj >> TILE_BITS, ((gi & _LOW) << TILE_BITS) | (gj & _LOW)


def _count_block(gi: np.ndarray, gj: np.ndarray, buckets: int):
    """Distinct pairs as (key, gi, gj, count), sorted by key, and for each given pair its place among them.

    A key is (part, t1, t2, strip): part 0 for a strip of a dense tile, part 1 for a bucket (t1) of sparse tiles.
    """
    t1, t2, cell = _tile(gi, gj)
    dense = (t1 + 1) * (t2 + 1) <= DENSE
    place = np.empty(len(gi), np.int64)
    keys, parts, base = [], [], 0
    look = np.empty(_CELLS, np.int32)
    in_tiles = np.flatnonzero(dense)
    tile = t1[in_tiles] * DENSE + t2[in_tiles]
    by_tile = in_tiles[np.argsort(tile, kind="stable")]
    for here in np.split(by_tile, np.flatnonzero(np.diff(np.sort(tile))) + 1) if len(tile) else ():
        counts = np.bincount(cell[here], minlength=_CELLS)
        hit = np.flatnonzero(counts)
        look[hit] = np.arange(base, base + len(hit))
        place[here] = look[cell[here]]
        a, b = int(t1[here[0]]), int(t2[here[0]])
        strip = hit >> (TILE_BITS + STRIP_BITS)
        for first, stop in _runs(strip):
            keys.append(((0, a, b, int(strip[first])), base + first, base + stop))
        parts.append(((a << TILE_BITS) + (hit >> TILE_BITS), (b << TILE_BITS) + (hit & _LOW), counts[hit]))
        base += len(hit)
    rest = np.flatnonzero(~dense)
    if len(rest):
        order = rest[np.lexsort((gj[rest], gi[rest]))]
        i, j = gi[order], gj[order]
        new = np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        first = np.flatnonzero(new)
        i, j, counts = i[first], j[first], np.diff(np.append(first, len(order)))
        bucket = ((i >> TILE_BITS) * 0x9E3779B1 + (j >> TILE_BITS) * 0x85EBCA77) % buckets
        by_bucket = np.argsort(bucket, kind="stable")
        at = np.empty(len(i), np.int64)
        at[by_bucket] = np.arange(len(i))
        place[order] = base + at[np.cumsum(new) - 1]
        parts.append((i[by_bucket], j[by_bucket], counts[by_bucket]))
        bucket = bucket[by_bucket]
        for first, stop in _runs(bucket):
            keys.append(((1, int(bucket[first]), 0, 0), base + first, base + stop))
    pairs = [np.concatenate([p[k] for p in parts]) for k in range(3)] if parts else [np.empty(0, np.int64)] * 3
    return keys, *pairs, place


def _runs(a: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values of a sorted array."""
    if not len(a):
        return []
    edges = np.append(np.flatnonzero(np.diff(a, prepend=a[0] - 1)), len(a)).tolist()
    return list(zip(edges, edges[1:]))


def _pack_pairs(part: int, gi: np.ndarray, gj: np.ndarray) -> tuple[bytes, bytes | None]:
    """The pairs of one key: cells of a strip by their distances, or coordinates."""
    if part == 0:
        return packed(np.diff(_tile(gi, gj)[2] & (_STRIP_CELLS - 1), prepend=0)), None
    return packed(np.diff(gi, prepend=0)), packed(gj)


def _unpack_pairs(key: tuple, at: bytes, other: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a strip and None, or coordinates."""
    first = np.cumsum(unpacked(at))
    return (first, None) if other is None else (first, unpacked(other))


def _count_pairs(buckets: int, last: bool):
    """Rows (block, lang, codes, local, gid) to counted pairs and, unless ``last``, the block of pair codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PAIRS.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(),
                 pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for r in range(batch.num_rows):
                block, lang = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                codes = unpacked(batch.column(2)[r].as_py()) - 1
                local, gid = (_numbers(batch.column(c)[r].values) for c in (3, 4))
                ids = np.full(int(codes.max(initial=-1)) + 2, -1, np.int64)
                ids[local] = gid
                # The last entry of ``ids`` stays -1, so code -1 meets it.
                g = ids[codes]
                at = np.flatnonzero((g[:-1] >= 0) & (g[1:] >= 0)) if len(g) else np.empty(0, np.int64)
                if not len(at):
                    continue
                keys, gi, gj, times, place = _count_block(g[at], g[at + 1], buckets)
                rows = [
                    (block, lang, *key, a, *_pack_pairs(key[0], gi[a:b], gj[a:b]), packed(times[a:b]), None) for key, a, b in keys
                ]
                if not last:
                    pairs = np.full(len(g), -1, np.int64)
                    pairs[at] = place
                    keep = (pairs >= 0) | (np.append(-1, pairs[:-1]) >= 0)
                    rows.append((block, lang, 2, *[None] * 7, packed(pairs[keep] + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _numbers(packs: pa.Array) -> np.ndarray:
    return np.concatenate([unpacked(b) for b in packs.to_pylist()] or [np.empty(0, np.int64)])


def _add_up(min_count: int):
    """Sorted strips and buckets to the pairs that occur often enough, one strip or bucket in memory."""

    def settled(key, strip, sparse):
        lang, part, t1, t2, s = key
        if part == 0:
            at = np.flatnonzero(strip >= min_count)
            cell = at + (s << (TILE_BITS + STRIP_BITS))
            gi, gj, a = (t1 << TILE_BITS) + (cell >> TILE_BITS), (t2 << TILE_BITS) + (cell & _LOW), strip[at]
        else:
            gi, gj, a = _merged(sparse)
            often = a >= min_count
            gi, gj, a = gi[often], gj[often], a[often]
        n = len(gi)
        same = lambda v, t: pa.array([v], t).take(pa.array(np.zeros(n, np.int64)))
        return pa.RecordBatch.from_arrays(
            [same(lang, pa.string()), same(part, pa.int32()), same(t1, pa.int64()), same(t2, pa.int64()), same(s, pa.int32()),
             pa.array(gi), pa.array(gj), pa.array(a)],
            names=[*KEY, "gi", "gj", "a"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, strip, sparse, held = None, None, [], 0
        for batch in batches:
            for r, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if key != now:
                    if now is not None:
                        yield settled(now, strip, sparse)
                    now, strip, sparse, held = key, np.zeros(_STRIP_CELLS if key[1] == 0 else 0, np.int64), [], 0
                first, second = _unpack_pairs(key, batch.column(5)[r].as_py(), batch.column(6)[r].as_py())
                times = unpacked(batch.column(7)[r].as_py())
                if second is None:
                    strip[first] += times
                    continue
                sparse.append((first, second, times))
                held += len(first)
                if held > 2 * max(len(sparse[0][0]), 500_000):
                    sparse = [_merged(sparse)]
                    held = len(sparse[0][0])
        if now is not None:
            yield settled(now, strip, sparse)

    return run


def _merged(parts):
    """Coordinate lists as one sorted list with the sums of equal coordinates."""
    gi, gj, a = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((gj, gi))
    gi, gj, a = gi[order], gj[order], a[order]
    first = np.flatnonzero(np.append(True, (gi[1:] != gi[:-1]) | (gj[1:] != gj[:-1])))
    return gi[first], gj[first], np.add.reduceat(a, first)


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted keys, the ids of a key's frequent pairs before its packs, to the ids of each block's pairs."""
    now, table, known = None, None, None
    for batch in batches:
        out = []
        for r, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
            block = batch.column(5)[r].as_py()
            if block is None:
                now, table, known = key, None, None
                gi, gj, gid = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (9, 10, 11))
                if key[1] == 0:
                    table = np.full(_STRIP_CELLS, -1, np.int64)
                    table[_tile(gi, gj)[2] & (_STRIP_CELLS - 1)] = gid
                else:
                    known = _finder(gi, gj, gid)
                continue
            if key != now:
                # None of the key's pairs is frequent.
                continue
            first, second = _unpack_pairs(key, batch.column(7)[r].as_py(), batch.column(8)[r].as_py())
            ids = table[first] if second is None else known(first, second)
            hit = np.flatnonzero(ids >= 0)
            if len(hit):
                out.append((block, packed(hit + batch.column(6)[r].as_py()), packed(ids[hit])))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.binary()))], names=["block", "local", "gid"]
            )


def _finder(gi: np.ndarray, gj: np.ndarray, gid: np.ndarray):
    """Ids of pairs by binary search, -1 for others."""
    rows, columns = np.unique(gi), np.unique(gj)
    code = lambda i, j: np.searchsorted(rows, i) * (len(columns) + 1) + np.searchsorted(columns, j)
    own = code(gi, gj)
    order = np.argsort(own)
    own, gi, gj, gid = own[order], gi[order], gj[order], gid[order]

    def find(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(own, code(i, j)), len(own) - 1)
        return np.where((gi[at] == i) & (gj[at] == j), gid[at], -1)

    return find


# --- phrases --------------------------------------------------------------------------------


def _score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """``floor(1000 * a * n / (l * r))`` in decimals of 38 digits."""
    whole = lambda c: c.cast("decimal(19,0)")
    top = (F.lit(1000).cast("decimal(4,0)") * whole(a)).cast("decimal(23,0)") * n.cast("decimal(15,0)")
    return F.call_function("div", top, whole(l) * whole(r))


def frequent_phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS
) -> tuple[list[DataFrame], DataFrame]:
    """Written tables of the phrases of 1, 2, ... words with ``min_count`` occurrences or more, and ``n`` by language.

    A table has lang, gid (rank by count), a, ``head`` and ``tail`` (counts of the first and last 1, 2, ... words),
    words, and for pairs gi and gj, the ids of the phrase without its last and without its first word.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = written(word_blocks(docs, 1 + size // BYTES_PER_BUCKET), tidy=True)
    totals = written(blocks.where("bucket IS NULL").groupBy("lang").agg(F.sum("n").alias("n")))
    packs, of_bucket = blocks.where("bucket IS NOT NULL"), ["lang", "bucket"]
    counted = (
        packs.select(*of_bucket, "words", "counts").repartition(*of_bucket).sortWithinPartitions(*of_bucket)
        .mapInArrow(_add_words(min_count), WORDS)
    )
    ids = ranked(counted, ["lang"], [F.desc("a"), F.asc("word")], "gid")
    one = written(
        ids.select("lang", "gid", "a", F.array("a").alias("head"), F.array("a").alias("tail"), F.array("word").alias("words"))
    )
    all_words = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = 1 + all_words // WORDS_PER_BUCKET
    tables = [one]
    # A bucket holds the frequent words of one bucket, bounded like these.
    names = ids.groupBy(*of_bucket).agg(F.collect_list(F.struct("word", "gid")).alias("p")).select(
        *of_bucket, F.lit(None).cast("string").alias("block"), F.lit(None).cast("binary").alias("words"),
        F.lit(None).cast("binary").alias("local"), F.col("p.word").alias("names"), F.col("p.gid").alias("gids"),
    )
    asked = names.unionByName(
        packs.select(
            *of_bucket, "block", "words", "local", F.lit(None).cast("array<string>").alias("names"), F.lit(None).cast("array<bigint>").alias("gids")
        )
    ).withColumn("_last", F.col("block").isNotNull())
    mapped = asked.repartition(*of_bucket).sortWithinPartitions(*of_bucket, "_last").drop("_last").mapInArrow(_resolved_words, MAPPED)
    coded = blocks.where("bucket IS NULL")
    for m in range(2, max_words + 1):
        of_block = mapped.groupBy("block").agg(F.collect_list(F.struct("local", "gid")).alias("ids"))
        units = coded.select("block", "lang", "codes").join(of_block, "block")
        found = written(
            units.select("block", "lang", "codes", "ids.local", "ids.gid").mapInArrow(_count_pairs(buckets, m == max_words), PAIRS),
            tidy=True,
        )
        deals = found.where("part < 2")
        sums = (
            deals.select(*KEY, "at", "other", "times").repartition(*KEY).sortWithinPartitions(*KEY)
            .mapInArrow(_add_up(min_count), COUNTED)
        )
        discard(blocks)
        blocks = found
        ids = ranked(sums, ["lang"], [F.desc("a"), F.asc("gi"), F.asc("gj")], "gid")
        before = tables[-1]
        first = before.select("lang", F.col("gid").alias("gi"), "head", F.col("words").alias("front"))
        second = before.select("lang", F.col("gid").alias("gj"), "tail", F.element_at("words", -1).alias("end"))
        tables.append(
            written(
                ids.join(first, ["lang", "gi"]).join(second, ["lang", "gj"]).select(
                    "lang", "gid", "a", F.concat("head", F.array("a")).alias("head"), F.concat("tail", F.array("a")).alias("tail"),
                    F.concat("front", F.array("end")).alias("words"), "gi", "gj",
                )
            )
        )
        if m == max_words:
            break
        # A key holds the frequent pairs of one strip or bucket, bounded like these.
        names = ids.groupBy(*KEY).agg(F.collect_list(F.struct("gi", "gj", "gid")).alias("p")).select(
            *KEY, F.lit(None).cast("string").alias("block"), F.lit(None).cast("bigint").alias("base"),
            F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("other"),
            F.col("p.gi").alias("gi"), F.col("p.gj").alias("gj"), F.col("p.gid").alias("gid"),
        )
        nothing = [F.lit(None).cast("array<bigint>").alias(c) for c in ("gi", "gj", "gid")]
        asked = names.unionByName(deals.select(*KEY, "block", "base", "at", "other", *nothing)).withColumn("_last", F.col("block").isNotNull())
        mapped = asked.repartition(*KEY).sortWithinPartitions(*KEY, "_last").drop("_last").mapInArrow(_resolved, MAPPED)
        coded = found.where("part = 2")
    discard(blocks)
    return tables, totals


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, inside_percent: int = INSIDE_PERCENT
) -> DataFrame:
    """The ``top`` phrases of each language with their counts, cut and score.

    Defined cases: null and empty texts have no words; a null language is ``und``, an empty one a language of its
    own; repeated rows count as often as they occur, with or without an id; equal scores and counts are ordered by
    the phrase in UTF-8 order; an empty table gives no rows; other columns are ignored.  A text is never cut: one
    very long text is one block, whose codes take four bytes a word.
    """
    tables, totals = frequent_phrases(docs, min_count, max_words)
    out = None
    for m in range(2, max_words + 1):
        mine = tables[m - 1].join(totals, "lang")
        cuts = F.transform(
            F.sequence(F.lit(1), F.lit(m - 1)),
            lambda k: F.struct(
                _score(F.col("a"), F.col("n"), F.element_at("head", k), F.element_at("tail", m - k)).alias("score"),
                k.alias("k"), F.element_at("head", k).alias("l"), F.element_at("tail", m - k).alias("r"),
            ),
        )
        scored = mine.select("lang", "gid", "a", "n", "words", F.array_min(cuts).alias("cut"))
        if m < max_words:
            # A longer phrase with this share of the count has extensions by one word with it as well.
            longer = (
                tables[m].select("lang", "a", F.explode(F.array("gi", "gj")).alias("gid"))
                .groupBy("lang", "gid").agg(F.max("a").alias("most"))
            )
            scored = scored.join(longer, ["lang", "gid"], "left").where(
                ~F.coalesce(100 * F.col("most") >= inside_percent * F.col("a"), F.lit(False))
            )
        rows = scored.select(
            "lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score", F.col("cut.k").alias("cut")
        )
        out = rows if out is None else out.unionByName(rows)
    best = top_rows(out, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return best.withColumn("rank", F.col("rank").cast("long"))


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Every phrase is counted by itself and every cut tried, from the texts.
SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), sizes AS (
  SELECT unnest(range(1, {MAX_WORDS + 1})) AS m
), places AS (
  SELECT lang, m, ws, unnest(range(1, len(ws) - m + 2)) AS s FROM lists, sizes WHERE len(ws) >= m
), f AS (
  SELECT lang, m, array_to_string(ws[s : s + m - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND f >= {MIN_COUNT}
), cuts AS (
  SELECT lang, m, phrase, a, ws, unnest(range(1, m)) AS k FROM candidates
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
         ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.m = c.k AND x.phrase = array_to_string(c.ws[1 : c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.m = c.m - c.k AND y.phrase = array_to_string(c.ws[c.k + 1 : c.m], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, a, ws, m, unnest(range(2, m)) AS w FROM candidates
), inner_places AS (
  SELECT lang, a, ws, w, unnest(range(1, m - w + 2)) AS s FROM inner_phrases
), inside AS (
  SELECT lang, array_to_string(ws[s : s + w - 1], ' ') AS phrase, max(a) AS most FROM inner_places GROUP BY ALL
), kept AS (
  SELECT c.* FROM lowest c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.most IS NULL OR 100 * i.most < {INSIDE_PERCENT} * c.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= {TOP}
"""
