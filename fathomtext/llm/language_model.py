"""Scoring texts with a weighted backoff automaton of bigrams.

States are the histories seen in training, arcs carry the smoothed probability of the next
token, and a failure arc leads to the root, the state without a history, with the
weight that the history leaves to tokens never seen after it.  A text is scored in
one pass from left to right that carries the state and adds up log-probabilities.

The probability of w after u is (c(u, w) + B * P(w)) / (c(u) + B): Dirichlet smoothing towards the
unigram P(w) = (c(w) + 1) / (N + V + 1), so the probabilities after each history sum to 1.

The automaton of a corpus does not fit into one task.  Texts are dealt to blocks of
bounded size, and each block builds the part of the automaton that its texts can reach.
For that it sends its distinct words and bigrams once, sorted and packed by hash range,
and gets their counts over all training texts back in the same order.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomtext.llm.common import ODD, WordHashes, fold, lower_ascii, mix, read_table, words, written

#: B: how many tokens the unigram weighs against a history's own counts.
BACKOFF_WEIGHT = 100.0
BLOCK_BYTES = 8_000_000
RANGE_ENTRIES = 1_000_000
#: Words and bigrams are told apart by 64 bits of their hash.
BITS = 64
#: The end of a text and the history of its first token.
END = np.uint64(0x5DEECE66D1234567)
START = np.uint64(0x3C6EF372FE94F82A)


def text_tokens(texts: list[str | None], hashed: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words with A-Z in lower case, then one end) and each text's number."""
    found = [words(lower_ascii(t)) if t else [] for t in texts]
    n = np.fromiter((len(f) + 1 for f in found), np.int64, len(found))
    out = np.full(int(n.sum()), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(n) - 1] = False
    out[inner] = hashed(list(chain.from_iterable(found)))
    return out, n


def bigrams(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprint of each token and its history, the token before or the start of the text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(n) - n] = START
    return mix(before * ODD + mix(tokens))


def pack(values: np.ndarray) -> bytes:
    """Byte planes of numbers; planes of zeros cost nothing once compressed."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def edges(fingers: np.ndarray, ranges: int) -> np.ndarray:
    """Where each hash range begins in sorted fingerprints, and the end of the last."""
    at = np.searchsorted(fingers, np.array([(i << BITS) // ranges for i in range(ranges)], np.uint64))
    return np.concatenate([at, [len(fingers)]])


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the order that sorts all, and where each value begins in it."""
    order = np.argsort(values)
    ranked = values[order]
    first = np.ones(len(values), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    heads = np.flatnonzero(first)
    return ranked[heads], order, heads


def distinct_counts(fingers: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, order, heads = grouped(fingers)
    return kinds, np.add.reduceat(weight[order], heads) if len(kinds) else np.zeros(0, np.int64)


def _count_block(pdf: pd.DataFrame, ranges: int) -> pd.DataFrame:
    """Packed distinct words and bigrams of a block with their counts in its training texts."""
    tokens, n = text_tokens(list(pdf["text"]), WordHashes())
    weight = np.repeat(pdf["trained"].to_numpy(np.int64), n)
    parts = []
    for fingers in (tokens, bigrams(tokens, n)):
        kinds, counts = distinct_counts(fingers, weight)
        at = edges(kinds, ranges)
        parts.append((kinds, counts, at))
    rows = []
    for r in range(ranges):
        row = [int(pdf["block"].iloc[0]), r]
        for kinds, counts, at in parts:
            a, b = at[r], at[r + 1]
            row += [pack(np.diff(kinds[a:b], prepend=np.uint64(0))), pack(counts[a:b])]
        if row[2] or row[4]:
            rows.append(row)
    return pd.DataFrame(rows, columns=["block", "range", "words", "word_counts", "pairs", "pair_counts"])


def _merge_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts over all blocks, handed back to each block in its own order; block -1 has the totals."""
    pdf = pdf.sort_values("block", ignore_index=True)
    out = {"block": [*map(int, pdf["block"]), -1], "range": [int(pdf["range"].iloc[0])] * (len(pdf) + 1)}
    tokens = kinds = 0
    for name, column in (("words", "word_counts"), ("pairs", "pair_counts")):
        each = [np.cumsum(unpack(raw), dtype=np.uint64) for raw in pdf[name]]
        distinct, place = np.unique(np.concatenate(each), return_inverse=True)
        weight = np.concatenate([unpack(raw) for raw in pdf[column]])
        counts = np.bincount(place, weights=weight, minlength=len(distinct)).astype(np.int64)
        if name == "words":
            tokens, kinds = int(counts.sum()), int((counts > 0).sum())
        ends = np.cumsum([len(e) for e in each])
        out[column] = [pack(counts[p]) for p in np.split(place, ends[:-1])] + [None]
    zeros = [0] * len(pdf)
    return pd.DataFrame(out | {"tokens": [*zeros, tokens], "kinds": [*zeros, kinds]})


class Automaton:
    """The part of the automaton that a block's tokens can reach.

    States and tokens are numbers of the block's words; the root is one more, and one more
    after that is the state at the start of a text.
    """

    def __init__(self, kinds, counts, pair_keys, pair_counts, total: int, distinct: int):
        k = len(kinds)
        self.root, self.start, self.width = k, k + 1, k + 2
        unigram = (counts + 1) / (total + distinct + 1)
        self.unigram = np.log10(unigram)
        # A text is begun as often as one is ended.
        ended = np.searchsorted(kinds, END)
        begun = int(counts[ended]) if ended < k and kinds[ended] == END else 0
        history = np.concatenate([counts, [0, begun]]).astype(np.float64)
        self.failure = np.log10(BACKOFF_WEIGHT / (history + BACKOFF_WEIGHT)).tolist()
        # Words never seen in training have no state of their own.
        self.next = np.where(counts > 0, np.arange(k), self.root).tolist()
        self.first = self.start if begun else self.root
        seen = pair_counts > 0
        state, token = np.divmod(pair_keys[seen], self.width)
        weight = (pair_counts[seen] + BACKOFF_WEIGHT * unigram[token]) / (history[state] + BACKOFF_WEIGHT)
        self.arcs = dict(zip(pair_keys[seen].tolist(), np.log10(weight).tolist()))
        self.root_arcs = self.unigram.tolist()

    def score(self, tokens: list[int]) -> float:
        """Log10 probability of a text: one traversal, falling back to the root where an arc is missing."""
        arcs, failure, root_arcs, onward, width = self.arcs.get, self.failure, self.root_arcs, self.next, self.width
        state, total = self.first, 0.0
        for token in tokens:
            weight = arcs(state * width + token)
            if weight is None:
                weight = failure[state] + root_arcs[token]
            total += weight
            state = onward[token]
        return total


def _score_block(docs: pd.DataFrame, counted: pd.DataFrame, total: int, distinct: int) -> pd.DataFrame:
    """Scores of a block's texts from the counts it got back."""
    tokens, n = text_tokens(list(docs["text"]), WordHashes())
    fingers = bigrams(tokens, n)
    counted = counted.sort_values("range")
    word_counts, pair_counts = (
        np.concatenate([unpack(raw) for raw in counted[c]]).astype(np.int64) for c in ("word_counts", "pair_counts")
    )
    kinds, order, heads = grouped(tokens)
    place = np.empty(len(tokens), np.int64)
    place[order] = np.repeat(np.arange(len(kinds)), np.diff(np.append(heads, len(tokens))))
    width = len(kinds) + 2
    history = np.empty_like(place)
    history[1:] = place[:-1]
    history[np.cumsum(n) - n] = len(kinds) + 1
    # One token of each kind of bigram names its state and its arc.
    _, order, heads = grouped(fingers)
    at = order[heads]
    machine = Automaton(kinds, word_counts, history[at] * width + place[at], pair_counts, total, distinct)
    owner = np.repeat(np.arange(len(docs)), n)
    sums = lambda x: np.bincount(owner, weights=x[place], minlength=len(docs))
    ends = np.cumsum(n)
    numbers = place.tolist()
    return pd.DataFrame(
        {
            "doc_id": docs["doc_id"],
            "trained": docs["trained"],
            "n_tokens": n,
            "n_known": sums((word_counts > 0).astype(float)).astype(np.int64),
            "base_score": sums(machine.unigram),
            "score": [machine.score(numbers[e - m : e]) for e, m in zip(ends.tolist(), n.tolist())],
        }
    )


def language_model_scores(docs: DataFrame, train: Column) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) of every text.

    ``train`` says which rows the counts are taken from; all rows are scored.

    Defined cases: null and empty texts consist of the end alone; a null in ``train`` means
    training; repeated rows count and are scored each; without training rows every token has
    probability 1 / (0 + 0 + 1); a null doc_id is kept; an empty table gives no rows; other
    columns are ignored.
    """
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(train, F.lit(True)).alias("trained"),
    )
    volume = source.agg(F.sum(F.octet_length("text") + 8).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(volume / BLOCK_BYTES))
    # A text has a token in some six bytes, and two of three tokens add a new bigram to a block.
    ranges = max(1, math.ceil(volume / 8 / RANGE_ENTRIES))
    dealt = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    schema = "block long, range long, words binary, word_counts binary, pairs binary, pair_counts binary"
    counts = dealt.groupBy("block").applyInPandas(lambda pdf: _count_block(pdf, ranges), schema)
    schema = "block long, range long, word_counts binary, pair_counts binary, tokens long, kinds long"
    merged = written(counts.groupBy("range").applyInPandas(_merge_range, schema))
    totals = merged.where(F.col("block") < 0).agg(F.sum("tokens").alias("t"), F.sum("kinds").alias("k")).first()
    total, distinct = int(totals["t"] or 0), int(totals["k"] or 0)
    schema = "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"
    back = merged.where(F.col("block") >= 0).select("block", "range", "word_counts", "pair_counts")
    scores = (
        dealt.groupBy("block")
        .cogroup(back.groupBy("block"))
        .applyInPandas(lambda a, b: _score_block(a, b, total, distinct), schema)
    )
    return scores.withColumn("train_tokens", F.lit(total).cast("long"))


def op8_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_model_scores(docs, fold(F.col("doc_id"), 7) != 2).select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


