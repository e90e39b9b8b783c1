"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

Texts become hashed counts of their words, of word shapes and of word beginnings and
ends.  A bounded sample of labelled texts gives term weights and, by a truncated
singular value decomposition, a projection to a few dense dimensions.  The labelled
vectors are broadcast; every document is compared with all of them in blocks, and its
nearest neighbours vote with their cosine as weight.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fathomtext.llm.common import fold, read_table, slices, words

FEATURES = 4096
DIMENSIONS = 64
NEIGHBOURS = 15
#: The first features are not hashed: shares of words that repeat what stands before.
OWN = 2
OWN_WEIGHT = 60.0
#: At most so many labelled texts of each label are fitted on.
SAMPLE_PER_LABEL = 1500
_RUN = re.compile(r"(.)\1+")
#: Letters below U+0250 and digits by their kind.
_KIND = {
    i: "X" if chr(i).isupper() else "x" if chr(i).islower() else "9" for i in range(0x250) if chr(i).isalnum()
}


def _features_of(word: str) -> list[int]:
    """Hashed features of one word: itself, its shape (twice), and both of its ends."""
    shape = _RUN.sub(r"\1+", word.translate(_KIND))
    low = word.lower()
    parts = ("w" + low, "s" + shape, "e" + word[-3:], "b" + low[:3])
    hashes = [OWN + xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) % (FEATURES - OWN) for p in parts]
    return [*hashes, hashes[1]]


class Featurizer:
    """Sublinear hashed counts of texts; each distinct word of a batch is looked at once."""

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, 5), np.int64)

    def codes(self, tokens: list[str]) -> np.ndarray:
        """Numbers of the words in the table, which is emptied when it is full."""
        if len(self.place) > self.limit:
            self.place, self.table = {}, self.table[:0]
        fresh = set(tokens).difference(self.place)
        if fresh:
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
            self.table = np.concatenate([self.table, np.array([_features_of(w) for w in fresh], np.int64)])
        return np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        found = [words(t) for t in texts]
        n = np.fromiter(map(len, found), np.int64, len(found))
        out = np.zeros((len(texts), FEATURES), np.float32)
        if not n.sum():
            return out
        codes = self.codes(list(chain.from_iterable(found)))
        doc = np.repeat(np.arange(len(texts)), n)
        cells = (doc * FEATURES)[:, None] + self.table[codes]
        out += np.log1p(np.bincount(cells.ravel(), minlength=out.size)).reshape(out.shape)
        again = np.bincount(doc[1:][(codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts))
        inside = doc[2:] == doc[:-2]
        keys = np.stack([doc[2:], codes[:-2], codes[1:-1], codes[2:]])[:, inside]
        keys = keys[:, np.lexsort(keys)]
        new = np.ones(keys.shape[1], bool)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        distinct = np.bincount(keys[0][new], minlength=len(texts))
        out[:, 0] = OWN_WEIGHT * again / np.maximum(n, 1)
        out[:, 1] = np.where(n > 2, OWN_WEIGHT * (1 - distinct / np.maximum(n - 2, 1)), 0)
        return out


@dataclass
class Model:
    """Bounded by the sample size, the number of features and the dimensions."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        z = (x / np.maximum(norms, 1e-9)) @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by cosine.

        A text without words has no neighbour and gets half the share of label 1, so it is rejected.
        """
        n = len(counts)
        if not len(self.labels):
            return np.full(n, 0.5)
        cosine = self.embed(counts) @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 4 + 1e-9
        votes = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.where(counts.any(axis=1), votes, self.prior / 2)


def fit(texts: list[str | None], labels: list[int], neighbours: int = NEIGHBOURS, seed: int = 5) -> Model:
    """Term weights, projection and labelled vectors of a bounded sample."""
    if not texts:
        return Model(np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5, neighbours)
    featurize = Featurizer()
    counts = np.concatenate([featurize(texts[a:b]) for a, b in slices(texts, 500_000)])
    idf = (np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 0.2).astype(np.float32)
    idf[:OWN] = 1
    x = counts * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    # Randomized range finder with power iterations.
    rank = min(DIMENSIONS, *x.shape)
    probe = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    basis = np.linalg.qr(x @ probe)[0]
    for _ in range(4):
        basis = np.linalg.qr(x @ np.linalg.qr(x.T @ basis)[0])[0]
    projection = np.ascontiguousarray(np.linalg.svd(basis.T @ x, full_matrices=False)[2][:rank].T)
    y = np.asarray(labels, np.float64)
    model = Model(idf, projection, np.zeros((0, rank), np.float32), y, float(y.mean()), neighbours)
    model.vectors = model.embed(counts)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: F.Column, per_label: int) -> DataFrame:
    """At most ``per_label`` rows (text, label) of each label, the first by a hash of the id.

    Only the chosen ids meet the texts, so the broadcast side has a fixed bound.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & train).groupBy("doc_id").agg(
        F.max(label).alias("label")
    )
    order = [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")]
    parts = [usable.where(F.col("label") == value).orderBy(*order).limit(per_label) for value in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def fitted(docs: DataFrame, labels: DataFrame, label: str, train: F.Column, per_label: int = SAMPLE_PER_LABEL) -> Model:
    rows = labelled_sample(docs.select("doc_id", "text"), labels, label, train, per_label)
    # The bounded sample is the training set; ids only order it.
    taken = rows.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return fit([r["text"] for r in taken], [int(r["label"]) for r in taken])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of the documents with ``score``; the text is the only input of it.

    Defined cases: null and empty texts score half the share of label 1; repeated rows score
    alike; without any labelled row every score is 0.5; an empty table stays empty; a
    column named score is replaced.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        featurize = Featurizer()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            scores = np.zeros(len(texts))
            for start, stop in slices(texts, 1_000_000):
                for a in range(start, stop, 256):
                    b = min(a + 256, stop)
                    scores[a:b] = shared.value.score(featurize(texts[a:b]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def training_rows() -> F.Column:
    return fold(F.col("doc_id"), 3) != 1


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fitted(docs, read_table(spark, sf_dir, "labels"), "quality", training_rows())
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
