"""Removal of byte strings that occur more than once, with suffix arrays.

Every window of ``width`` bytes chooses an anchor among its k-grams: the one with the
smallest hash, leftmost first.  Equal windows choose the same anchor at the same offset,
so windows can only be equal where anchors are, and anchors are about one in 80 bytes.

Anchors that occur once are dropped.  Occurrences whose whole surroundings (all windows
that can hold the anchor) are equal are repeated as they are.  The others are split by the
offset of the anchor, which again drops what is alone and settles what is equal.  What
remains goes to shards by content: equal windows meet in one shard, where a suffix array
and its common prefixes find them.  A string with very many different surroundings is
spread over several shards, whose sorted distinct windows are merged by binary search.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomtext.llm.common import discard, mix, read_table, slices, written
from fathomtext.llm.suffixes import common_prefixes, eight_bytes, joined, suffix_array

GRAM = 32
STEP = 24
SHARD_BYTES = 1_500_000
SHARD_PIECES = 16_000
#: Length of a window in a piece, where eight bytes stand for what its key's windows share.
SHORT = STEP - 1 + 8
_PLACE_BITS = 28
_C = [int(x) | 1 for x in mix(np.arange(11, 15, dtype=np.uint64))]


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in a block of texts and the hashes of their k-grams."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = eight_bytes(data)
    m = n - GRAM + 1
    h = np.zeros(m, np.uint64)
    for i, c in enumerate(_C):
        h += words[8 * i : 8 * i + m] * np.uint64(c)
    h = mix(h)
    low = (h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(m, dtype=np.uint64)
    span, size = width - GRAM + 1, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    # A window must lie inside one text.
    inside = np.zeros(len(low) + 1, np.int64)
    long = ends - starts >= width
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - width + 1, -1)
    chosen = low[np.cumsum(inside[:-1]) > 0] & np.uint64((1 << _PLACE_BITS) - 1)
    places = np.unique(chosen.astype(np.int64))
    return places, h[places]


def _surroundings(data, places, starts, ends, width: int) -> np.ndarray:
    """Hash of all bytes of windows that can hold each anchor, cut at the text's ends."""
    reach = width - GRAM
    size = reach + width
    padded = np.zeros(len(data) + size + reach + 8, np.uint8)
    padded[reach : reach + len(data)] = data
    size8 = (size + 7) // 8 * 8
    rows = np.lib.stride_tricks.sliding_window_view(padded, size8)
    out = np.empty(len(places), np.uint64)
    factors = mix(np.arange(1, size8 // 8 + 1, dtype=np.uint64)) | np.uint64(1)
    columns = np.arange(size8)
    for at in range(0, len(places), 20_000):
        p = places[at : at + 20_000]
        left = np.minimum(p - starts[at : at + 20_000], reach)
        right = np.minimum(ends[at : at + 20_000] - p, width)
        block = rows[p].copy()
        cut = np.flatnonzero((left < reach) | (right < width) | (size8 > size))
        block[cut] *= (columns >= reach - left[cut, None]) & (columns < reach + right[cut, None])
        lanes = mix(block.view("<u8"))
        out[at : at + 20_000] = mix((lanes * factors).sum(axis=1, dtype=np.uint64) + (left * 1024 + right).astype(np.uint64))
    return out


def _parts(raw: bytes, width: int, most: int = 8_000_000):
    """A long text in overlapping parts: (offset, bytes, lo, hi).

    Anchors of a part count from lo up to hi; there, the part holds all windows that
    could choose them, and the ranges of neighbours meet.
    """
    reach = width - GRAM
    at = 0
    while True:
        last = at + most >= len(raw)
        yield at, raw[at : at + most], reach if at else 0, len(raw) - at if last else most - width
        if last:
            return
        at += most - width - reach


def _anchored(batches, width: int):
    """(h, around, doc, place) of every anchor of Arrow batches (doc, text)."""
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices(texts, 1_000_000):
            raw = [t.encode() if t else b"" for t in texts[a:b]]
            lengths = np.fromiter(map(len, raw), np.int64, len(raw))
            if lengths.sum() > 8_000_000 and len(raw) == 1:
                parts = list(_parts(raw[0], width))
            else:
                parts = [(0, b"".join(raw), 0, int(lengths.sum()))]
            for offset, block, lo, hi in parts:
                data = np.frombuffer(block, np.uint8)
                ends = np.cumsum(lengths) if len(parts) == 1 else np.array([len(data)])
                starts = ends - lengths if len(parts) == 1 else np.array([0])
                places, h = anchors(data, starts, ends, width)
                taken = (places >= lo) & (places < hi)
                places, h = places[taken], h[taken]
                if not len(places):
                    continue
                which = np.searchsorted(ends, places, side="right")
                around = _surroundings(data, places, starts[which], ends[which], width)
                owner = which + a
                ids = np.array(docs, dtype=np.int64)[owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)),
                        pa.array(around.view(np.int64)),
                        pa.array(ids),
                        pa.array((places - starts[which] + offset).astype(np.int64)),
                    ],
                    ["h", "around", "doc", "place"],
                )


def _split(batches, width: int):
    """Parts of the surroundings of unsettled anchors by the offset of the anchor.

    Input rows (doc, text, spots); a part holds the windows in which the anchor stands
    ``lo`` to ``hi`` bytes from the start.  ``key`` is the hash of what all of them share, ``whole`` of
    all their bytes.
    """
    reach = width - GRAM
    names = ["key", "whole", "doc", "at", "left", "size", "open"]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for doc, text, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = text.encode()
            n = len(raw)
            for spot in spots:
                p, h = spot["place"], spot["h"]
                for lo in range(0, reach + 1, STEP):
                    hi = min(lo + STEP - 1, reach)
                    if p < lo or p + width - hi > n:
                        continue
                    start, stop = max(0, p - hi), min(n, p + width - lo)
                    if stop - start < width:
                        continue
                    part = raw[start:stop]
                    shared = xxhash.xxh3_64_intdigest(raw[p - lo : p + width - hi], seed=(h ^ lo) & 0xFFFFFFFFFFFFFFFF)
                    whole = xxhash.xxh3_64_intdigest(part, seed=p - start)
                    for column, value in zip(rows, (shared, whole, doc, start, p - lo - start, stop - start, spot["open"])):
                        column.append(value)
        if rows[0]:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(rows[0], np.uint64).view(np.int64)),
                    pa.array(np.array(rows[1], np.uint64).view(np.int64)),
                    pa.array(rows[2], pa.int64()),
                    pa.array(rows[3], pa.int64()),
                    pa.array(rows[4], pa.int32()),
                    pa.array(rows[5], pa.int32()),
                    pa.array(rows[6], pa.bool_()),
                ],
                names,
            )


def _fetched(batches, width: int):
    """Pieces from rows (doc, text, asked): the asked parts with their key in place of what it stands for.

    All windows of a part hold the bytes that its key is the hash of, so two windows are
    equal if their keys, the bytes before and the bytes after are.
    """
    shared = width - STEP + 1
    names = ["shard", "doc", "at", "open", "spread", "bytes"]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = text.encode()
            for a in asked:
                at, middle = a["at"], a["at"] + a["left"]
                piece = raw[at:middle] + a["key"].to_bytes(8, "little", signed=True) + raw[middle + shared : at + a["size"]]
                for column, value in zip(rows, (a["shard"], doc, at, a["open"], a["spread"], piece)):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names)


def repeated_windows(pieces: list[bytes], doc: np.ndarray, at: np.ndarray, width: int):
    """Windows of a shard in suffix order.

    Returns the piece and the offset of each whole window, the number of its run of equal
    windows, and whether its run has two different places.
    """
    data, owner, rest = joined(pieces)
    sa = suffix_array(data, rest)
    same = common_prefixes(data, rest, sa, width) >= width
    fits = rest[sa] >= width
    sa, same = sa[fits], same[fits]
    run = np.cumsum(~same)
    piece = owner[sa]
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    offset = lengths[piece] - rest[sa]
    place = (np.unique(doc, return_inverse=True)[1][piece].astype(np.int64) << 40) + at[piece] + offset
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    several = np.zeros(len(run), bool)
    if len(run):
        differ = np.maximum.reduceat(place, first) != np.minimum.reduceat(place, first)
        several = np.repeat(differ, np.diff(np.concatenate([first, [len(run)]])))
    return piece, offset, run, several


def _spans(piece, offset, doc, at, width: int) -> pd.DataFrame:
    """Covered bytes (doc, lo, hi) of windows, neighbours in one row."""
    order = np.lexsort((offset, piece))
    piece, offset = piece[order], offset[order]
    if not len(piece):
        return pd.DataFrame({"doc": doc[:0], "lo": at[:0], "hi": at[:0]})
    new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(piece)]]) - 1
    p = piece[first]
    return pd.DataFrame({"doc": doc[p], "lo": at[p] + offset[first], "hi": at[p] + offset[last] + width})


def _shard(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """Spans of one shard; for strings spread over shards also their distinct windows."""
    pieces = list(pdf["bytes"])
    doc, at = pdf["doc"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64)
    wanted, spread = pdf["open"].to_numpy(bool), pdf["spread"].to_numpy(bool)
    piece, offset, run, several = repeated_windows(pieces, doc, at, SHORT)
    hit = several & wanted[piece]
    found = _spans(piece[hit], offset[hit], doc, at, width).assign(one=None, two=None)
    # A run is settled here if it has two places; elsewhere it still is a partner.
    head = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
    out = np.flatnonzero(head & spread[piece])
    if len(out):
        windows = [pieces[p][o : o + SHORT] for p, o in zip(piece[out], offset[out])]
        digest = [xxhash.xxh3_128_digest(w) for w in windows]
        pair = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        lone = wanted[piece[out]] & ~several[out]
        found = pd.concat(
            [
                found,
                pd.DataFrame(
                    {
                        "doc": doc[piece[out]],
                        "lo": at[piece[out]] + offset[out],
                        "hi": np.where(lone, at[piece[out]] + offset[out] + width, -1),
                        "one": pair[:, 0],
                        "two": pair[:, 1],
                    }
                ),
            ]
        )
    return found.astype({"one": "Int64", "two": "Int64"})


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows of several shards that are equal: binary search in the sorted windows."""
    pdf = pdf.sort_values(["one", "two"], ignore_index=True)
    pair = np.empty(len(pdf), dtype=[("one", "<i8"), ("two", "<i8")])
    pair["one"], pair["two"] = pdf["one"].to_numpy(np.int64), pdf["two"].to_numpy(np.int64)
    group = np.cumsum(np.concatenate([[False], pair[1:] != pair[:-1]]))
    count = np.searchsorted(group, group, side="right") - np.searchsorted(group, group, side="left")
    return pdf.loc[(count > 1) & (pdf["hi"].to_numpy() >= 0), ["doc", "lo", "hi"]]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc): every row under a key of its own.

    The key is the id.  Where ids are null or repeat, the rows are written with a running
    number, so that equal rows are documents of their own.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    odd = source.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("doc_id").isNull())
    if odd.limit(1).count():
        return written(source.withColumn("doc", F.monotonically_increasing_id()))
    return source.withColumn("doc", F.col("doc_id"))


def repeated_spans(keyed: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc, lo, hi) rows that cover the repeated bytes, and the texts of those that may have some."""
    texts = keyed.where(F.octet_length("text") >= width).select("doc", "text")
    schema = "h long, around long, doc long, place long"
    found = texts.mapInArrow(lambda b: _anchored(b, width), schema)
    several = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("h")
    shared = written(found.join(several, "h"), tidy=True)

    of_around = written(
        shared.groupBy("h", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "place")).alias("rep")), tidy=True
    )
    equal = of_around.where(F.col("n") > 1).select("h", "around")
    reach = width - GRAM
    settled = shared.join(equal, ["h", "around"]).select(
        "doc",
        F.greatest(F.col("place") - reach, F.lit(0)).alias("lo"),
        (F.col("place") + width).alias("hi"),
    )
    settled = written(settled, tidy=True)
    unlike = of_around.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1).select("h")
    spots = (
        of_around.join(unlike, "h")
        .select("rep.doc", F.struct("rep.place", "h", (F.col("n") == 1).alias("open")).alias("spot"))
        .groupBy("doc")
        .agg(F.collect_list("spot").alias("spots"))
    )
    some = written(texts.join(shared.select("doc").distinct(), "doc"), tidy=True)
    schema = "key long, whole long, doc long, at long, left int, size int, open boolean"
    cut = some.join(spots, "doc").select("doc", "text", "spots").mapInArrow(lambda b: _split(b, width), schema)
    parts = written(cut, tidy=True)
    discard(shared, of_around)

    of_whole = parts.groupBy("key", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "at", "left", "size", "open")).alias("rep")
    )
    # A part that is alone under its key is settled: nothing is equal to any of its windows.
    kinds = parts.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).select("key")
    of_whole = written(of_whole.join(kinds, "key"), tidy=True)
    alike = of_whole.where(F.col("n") > 1).select("key", "whole")
    settled_parts = parts.where("open").join(alike, ["key", "whole"])
    settled_parts = settled_parts.select("doc", F.col("at").alias("lo"), (F.col("at") + F.col("size")).alias("hi"))
    settled_parts = written(settled_parts, tidy=True)
    discard(parts)

    kinds = of_whole.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
    total = kinds.agg(F.sum("kinds").alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(total * (SHORT + STEP) / SHARD_BYTES))
    salts = F.ceil(F.col("kinds") / SHARD_PIECES)
    left = of_whole.join(kinds, "key").select(
        F.col("rep.doc").alias("doc"),
        F.struct(
            F.pmod(F.xxhash64("key", F.pmod(F.xxhash64("rep"), salts)), F.lit(shards)).alias("shard"),
            "key",
            F.col("rep.at").alias("at"),
            F.col("rep.left").alias("left"),
            F.col("rep.size").alias("size"),
            (F.col("rep.open") & (F.col("n") == 1)).alias("open"),
            (salts > 1).alias("spread"),
        ).alias("part"),
    )
    asked = left.groupBy("doc").agg(F.collect_list("part").alias("asked"))
    schema = "shard long, doc long, at long, open boolean, spread boolean, bytes binary"
    salted = some.join(asked, "doc").select("doc", "text", "asked").mapInArrow(lambda b: _fetched(b, width), schema)
    schema = "doc long, lo long, hi long, one long, two long"
    sharded = written(salted.groupBy("shard").applyInPandas(lambda pdf: _shard(pdf, width), schema), tidy=True)
    discard(of_whole)
    apart = sharded.where(F.col("one").isNotNull())
    buckets = max(1, math.ceil(apart.count() / 500_000))
    across = (
        apart.groupBy(F.pmod(F.xxhash64("one", "two"), F.lit(buckets)))
        .applyInPandas(_merged, "doc long, lo long, hi long")
    )
    inside = sharded.where(F.col("one").isNull()).select("doc", "lo", "hi")
    return settled.unionByName(settled_parts).unionByName(inside).unionByName(across), some


def _cut(batches):
    """Removed runs and what is left of each document of Arrow batches (doc, text, spans)."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = text.encode()
            runs: list[list[int]] = []
            for span in sorted((s["lo"], min(s["hi"], len(raw))) for s in spans):
                if runs and span[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], span[1])
                else:
                    runs.append(list(span))
            kept, at = [], 0
            for lo, hi in runs:
                kept.append(raw[at:lo])
                at = hi
            kept.append(raw[at:])
            for column, value in zip(out, (doc, runs, sum(hi - lo for lo, hi in runs), b"".join(kept))):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out[0], pa.int64()),
                pa.array(out[1], pa.list_(pa.list_(pa.int64()))),
                pa.array(out[2], pa.int64()),
                pa.array(out[3], pa.binary()),
            ],
            ["doc", "removed", "n_removed", "kept_bytes"],
        )


def remove_repeats(docs: DataFrame, width: int = 200) -> tuple[DataFrame, DataFrame]:
    """Documents with repeated bytes, and all rows under the key that joins the two.

    The first table has ``doc``, ``removed`` (maximal runs [lo, hi) of bytes), ``n_removed`` and
    ``kept_bytes``; a document that is not in it loses nothing.

    Defined cases: a null text is empty; texts shorter than ``width`` bytes lose nothing; strings
    never cross documents; every row is a document, so rows equal in id and text, null ids
    included, are copies of each other; very long texts are cut into parts; an empty table gives no
    rows; other columns are ignored.
    """
    keyed = _keyed(docs)
    spans, texts = repeated_spans(keyed, width)
    gathered = spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    schema = "doc long, removed array<array<long>>, n_removed long, kept_bytes binary"
    return texts.join(gathered, "doc").select("doc", "text", "spans").mapInArrow(_cut, schema), keyed


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, keyed = remove_repeats(read_table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    all_docs = keyed.select(
        "doc_id", "doc", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole")
    )
    changed = cut.select(
        "doc", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256")
    )
    zero = F.lit(0).cast("long")
    return all_docs.join(changed, "doc", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )
