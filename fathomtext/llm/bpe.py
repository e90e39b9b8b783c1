"""Byte-level BPE encoding and decoding.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are
tokens themselves.  Tier two: the others are merged pair by pair, lowest rank and
leftmost first, short ones by scanning their few pairs, long ones with a heap over a
linked list of byte runs.
"""

from __future__ import annotations

import base64
import gc
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fathomtext.llm.common import mix, ragged, read_table, slices

#: Up to so many bytes, scanning all pairs for the lowest rank takes less time than a heap.
SHORT = 48
_NONE = 1 << 60


class PerfectHash:
    """Minimal perfect hash from byte strings to 0..n-1 by hash and displace.

    Keys are thrown into buckets; from the fullest on, each bucket gets a
    displacement that sends its keys to free slots.  A bucket of one key names
    its slot directly, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 3)
        h = self.hashes(keys)
        if len(np.unique(h)) != self.n:
            raise ValueError("two keys share a hash")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(counts)
        self.shift = np.zeros(self.buckets, np.int64)
        self.owner = np.full(max(1, self.n), -1, np.int64)
        taken = np.zeros(max(1, self.n), bool)
        tries = np.arange(256, dtype=np.uint64)
        for b in np.argsort(-counts, kind="stable"):
            if counts[b] <= 1:
                break
            members = order[ends[b] - counts[b] : ends[b]]
            base = 0
            while True:
                at = self._slots(h[members][None, :], (tries + np.uint64(base))[:, None])
                free = ~taken[at].any(axis=1)
                for t in np.flatnonzero(free):
                    if len(set(at[t])) == len(members):
                        break
                else:
                    base += 256
                    continue
                self.shift[b] = base + int(t)
                taken[at[t]] = True
                self.owner[at[t]] = members
                break
        spare = iter(np.flatnonzero(~taken[: self.n]))
        for b in np.flatnonzero(counts == 1):
            slot = next(spare)
            self.shift[b] = -1 - slot
            self.owner[slot] = order[ends[b] - 1]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(h ^ (shift + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(self.n)).astype(np.int64)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """The only key of the set that each string can be, by its place in the set."""
        h = self.hashes(keys)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, self._slots(h, np.maximum(shift, 0).astype(np.uint64)))
        return self.owner[slot]


class Tokenizer:
    """A vocabulary of ranks with its split pattern; made once, sent to every executor.

    Its size is that of the vocabulary, whatever the corpus.
    """

    def __init__(self, path: str, pattern: str, memo: int = 300_000):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.pattern = pattern
        self.keys = list(self.ranks)
        self.ids = np.fromiter(self.ranks.values(), np.int64, len(self.keys))
        self.table = PerfectHash(self.keys)
        by_id: list[bytes] = [b""] * (int(self.ids.max()) + 1)
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.lengths = np.fromiter(map(len, by_id), np.int64, len(by_id))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.limit = memo
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.split = self.cut = None

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "pieces": {}, "split": None, "cut": None}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is not itself a token."""
        return self.scanned(piece) if len(piece) <= SHORT else self.heaped(piece)

    def scanned(self, piece: bytes) -> tuple[int, ...]:
        """The merges of a short pre-token; its first lowest pair is looked for again each time."""
        rank_of = self.ranks.get
        ends = list(range(len(piece) + 1))
        pair = [rank_of(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
        while pair:
            rank = min(pair)
            if rank == _NONE:
                break
            i = pair.index(rank)
            del pair[i], ends[i + 1]
            if i < len(pair):
                pair[i] = rank_of(piece[ends[i] : ends[i + 2]], _NONE)
            if i:
                pair[i - 1] = rank_of(piece[ends[i - 1] : ends[i + 1]], _NONE)
        return tuple([self.ranks[piece[a:b]] for a, b in zip(ends, ends[1:])])

    def heaped(self, piece: bytes) -> tuple[int, ...]:
        """The merges of a long pre-token.

        A heap entry is the rank of a pair and its first byte in one number; it is
        stale when ``pair`` holds another rank for that byte by now.
        """
        rank_of, n = self.ranks.get, len(piece)
        bits = n.bit_length()
        low = (1 << bits) - 1
        # Runs are named by their first byte; after[i] is the end of run i.
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pair = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        heap = [(rank << bits) | i for i, rank in enumerate(pair) if rank >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & low
            if pair[i] != entry >> bits:
                continue
            mid = after[i]
            end = after[i] = after[mid]
            pair[mid] = pair[i] = -1
            if end < n:
                before[end] = i
                rank = pair[i] = rank_of(piece[i : after[end]], -1)
                if rank >= 0:
                    heappush(heap, (rank << bits) | i)
            left = before[i]
            if left >= 0:
                rank = pair[left] = rank_of(piece[left:end], -1)
                if rank >= 0:
                    heappush(heap, (rank << bits) | left)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def resolve(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of distinct pre-tokens."""
        memo = self.pieces
        if len(memo) > self.limit:
            memo.clear()
        fresh = [p for p in pieces if p not in memo]
        if fresh:
            raw = [p.encode() for p in fresh]
            for piece, data, at in zip(fresh, raw, self.table.candidates(raw).tolist()):
                memo[piece] = (int(self.ids[at]),) if self.keys[at] == data else self.merged(data)
        return [memo[p] for p in pieces]

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of new chunks into the memo, pre-token by pre-token."""
        found = {c: self.split.findall(c) for c in chunks}
        distinct = list(set(chain.from_iterable(found.values())))
        ids = dict(zip(distinct, self.resolve(distinct))) if distinct else {}
        for chunk, pieces in found.items():
            self.memo[chunk] = tuple(chain.from_iterable(map(ids.__getitem__, pieces)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of each text's ids.

        Texts are first cut before every space between two characters that are no
        white space.  A match of the pattern always ends there, so cutting changes
        nothing, and most chunks have been seen before.
        """
        if self.split is None:
            self.split = regex.compile(self.pattern)
            self.cut = regex.compile(r"(?<=\S) (?=\S)")
        # Keys of the memo keep the space that the cut takes away.
        chunks: list[str] = []
        counts = []
        for text in texts:
            before = len(chunks)
            if text:
                parts = text.split(" ")
                if "" in parts or any(p.strip() != p for p in parts):
                    # White space next to a space: only the pattern's own idea of it counts.
                    parts = self.cut.split(text)
                chunks.append(parts[0])
                chunks.extend([" " + p for p in parts[1:]])
            counts.append(len(chunks) - before)
        if len(self.memo) > self.limit:
            self.memo.clear()
        self.learn(set(chunks).difference(self.memo))
        resolved = list(map(self.memo.__getitem__, chunks))
        lengths = np.fromiter(map(len, resolved), np.int64, len(resolved))
        ids = np.fromiter(chain.from_iterable(resolved), np.int32, int(lengths.sum()))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)])

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        return self.blob[ragged(self.starts[ids], lengths)].tobytes()


def _with_columns(df: DataFrame, made: list[tuple[str, T.DataType]], make, without: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns that ``make`` computes from each Arrow batch, keeping all others but ``without``."""
    names = [name for name, _ in made]
    df = df.drop(*names)
    kept = [i for i, field in enumerate(df.schema.fields) if field.name not in without]
    schema = T.StructType([*[df.schema.fields[i] for i in kept], *[T.StructField(*m) for m in made]])

    def run(batches):
        for batch in batches:
            for start, stop, columns in make(batch):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *columns], schema.names)

    return df.mapInArrow(run, schema)


def _ids_of(tokenizer: Tokenizer, texts: list[str | None]) -> pa.ListArray:
    # The memo holds many tuples and no cycles: searching it for cycles over and over only costs time.
    gc.disable()
    try:
        ids, counts = tokenizer.encode(texts)
    finally:
        gc.enable()
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def _bytes_of(tokenizer: Tokenizer, lists: pa.ListArray) -> pa.Array:
    out = []
    for row in lists:
        ids = row.values
        out.append(None if ids is None else tokenizer.decode(ids.to_numpy(zero_copy_only=False)))
    return pa.array(out, pa.binary())


IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, tokenizer, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the token ids of every whole text; ``tokenizer`` is a broadcast :class:`Tokenizer`.

    Defined cases: a null or empty text has no ids; special tokens are ordinary
    text; a column named like ``ids_col`` is replaced, all others are kept; each row is
    encoded by itself, so repeated rows repeat their ids; an empty table stays empty.
    """

    def make(batch):
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        for start, stop in slices(texts):
            yield start, stop, [_ids_of(tokenizer.value, texts[start:stop])]

    return _with_columns(df, [(ids_col, IDS)], make)


def decode(df: DataFrame, tokenizer, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null ids give null, no ids no bytes."""

    def make(batch):
        yield 0, batch.num_rows, [_bytes_of(tokenizer.value, batch.column(batch.schema.get_field_index(ids_col)))]

    return _with_columns(df, [(bytes_col, T.BinaryType())], make)


def round_trip(
    df: DataFrame, tokenizer, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded"
) -> DataFrame:
    """:func:`encode` and then :func:`decode` in one pass, without the text.

    A task runs one Python worker with one copy of the vocabulary, and neither texts nor ids are sent twice.
    """

    def make(batch):
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        for start, stop in slices(texts):
            ids = _ids_of(tokenizer.value, texts[start:stop])
            yield start, stop, [ids, _bytes_of(tokenizer.value, ids)]

    return _with_columns(df, [(ids_col, IDS), (bytes_col, T.BinaryType())], make, without=(text_col,))


def public_tokenizer(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken"):
    """The broadcast tokenizer of a public vocabulary file; its size is the vocabulary's."""
    import public_tokenizers

    return spark.sparkContext.broadcast(Tokenizer(public_tokenizers.path(name), public_tokenizers.PATTERN))


def token_digests(docs: DataFrame, tokenizer) -> DataFrame:
    """Per document the number of ids and the digests of the ids and of the decoded bytes."""
    return round_trip(docs.select("doc_id", "text"), tokenizer).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents"), public_tokenizer(spark))
