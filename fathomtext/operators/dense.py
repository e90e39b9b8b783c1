"""Embeddings, point ids and exact cosine search."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fathomtext.functions.exprs import bind
from fathomtext.functions.stats import top_rows
from fathomtext.functions.text import words
from fathomtext.operators.fusion import SearchFilters
from fathomtext.sources.staging import staged

DEFAULT_DIM = 128
QUERY_BLOCK_BYTES = 2 << 20
TILE_ROWS, TILE_QUERIES = 2048, 1024


# --- ids ------------------------------------------------------------------------------


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_OID) -> Column:
    """Name-based UUID, version 5, from SHA-1 and string functions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    return bind(
        digest,
        lambda d: F.concat(
            F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-5"), F.substring(d, 14, 3),
            F.lit("-"), F.translate(F.substring(d, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12),
        ),
    )


def point_id(chunk_id: Column) -> Column:
    return uuid5(F.concat(F.lit("chunk:"), chunk_id))


def section_point_id(document_id: Column, section_id: Column) -> Column:
    return uuid5(F.concat(F.lit("section:"), document_id, F.lit(":"), section_id))


# --- embedding --------------------------------------------------------------------------


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return bind(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def _counts_to_unit(dim: int):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(buckets: pd.Series) -> pd.Series:
        lengths = buckets.map(lambda b: 0 if b is None else len(b)).to_numpy(np.int64)
        out = np.zeros(len(buckets) * dim)
        if lengths.sum():
            cells = np.concatenate([b for b in buckets if b is not None and len(b)]).astype(np.int64)
            cells += np.repeat(np.arange(len(buckets)) * dim, lengths)
            out = np.bincount(cells, minlength=len(out)).astype(np.float64)
        unit = _unit_rows(out.reshape(len(buckets), dim)).astype(np.float32)
        return pd.Series(list(unit), index=buckets.index)

    return run


def word_bucket(word: Column, dim: int) -> Column:
    """Stable bucket of a word: 28 bits of its MD5, modulo the dimension."""
    return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int") % dim


def hashed_embedding(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Deterministic default embedding: hashed word counts of unit length."""
    buckets = F.transform(words(text), lambda w: word_bucket(w, dim))
    return _counts_to_unit(dim)(buckets)


def model_embedding(
    text: Column, make_predict: Callable[[], Callable], batch_size: int = 64
) -> Column:
    """Embedding by a model the caller supplies, in batches on the executors.

    ``make_predict`` loads the model once per worker and returns a function
    from a string array to a matrix.
    """
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return udf(text)


def with_query_instruction(query: Column, instruction: str = "") -> Column:
    return F.concat(F.lit(instruction), query)


# --- search -----------------------------------------------------------------------------


def prefiltered(vectors: DataFrame, filters: SearchFilters | None) -> DataFrame:
    """Metadata filter before the search; it reaches the table scan."""
    condition = filters.condition() if filters else None
    return vectors if condition is None else vectors.where(condition)


def _best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row positions of the k best scores, ties by id; exact on ties at the cut."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= cut)
    else:
        rows = np.arange(len(scores))
    return rows[np.lexsort((ids[rows], -scores[rows]))[:k]]


def _blocks_of(rows: DataFrame, id_col: str, vector_col: str, d: int, per_block: int) -> DataFrame:
    """Vectors of length ``d`` as unit rows, ``per_block`` to a block: ``ids`` and ``matrix``.

    Lengths and nulls are judged here, where the vectors lie: a filter would be pushed below an embedding and repeat it.
    """
    id_type = rows.schema[id_col].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("matrix", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            right = pc.fill_null(pc.equal(pc.list_value_length(lists), d), False)
            ids, kept = batch.column(0).filter(right), lists.filter(right)
            flat = kept.flatten()
            m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(kept), d)
            if flat.null_count:
                whole = pc.is_valid(flat).to_numpy(zero_copy_only=False).reshape(len(kept), d).all(axis=1)
                ids, m = ids.filter(pa.array(whole)), m[whole]
            unit = _unit_rows(m)
            for start in range(0, len(ids), per_block):
                mine = ids.slice(start, per_block)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine), pa.array([unit[start : start + per_block].tobytes()])],
                    names=schema.names,
                )

    return rows.select(id_col, vector_col).mapInArrow(run, schema)


def cosine_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 50,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    decimals: int = 9,
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """Exact cosine top ``k`` per query: ``query_id, id_col, score, rank``.

    Queries and vectors are tables of blocks of rows, and every block of queries meets every block of vectors.  Spark
    decides by the size of the query blocks whether they are broadcast or the partitions of both meet one by one; the
    driver holds neither.  A task keeps the ``k`` best of each query it has seen and tests later blocks against the last
    of them.  Null vectors and vectors of another length than the queries' have no score; null or shorter queries have
    no hits.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("v"))
    d = q.agg(F.max(F.when(~F.exists("v", lambda x: x.isNull()), F.size("v"))).alias("d")).first()["d"]
    id_type, qid_type = vectors.schema[id_col].dataType, q.schema["query_id"].dataType
    schema = T.StructType(
        [T.StructField("query_id", qid_type), T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())]
    )
    if not d or d < 0:
        return vectors.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    per_block = max(1, min(TILE_QUERIES, block_bytes // (8 * d)))
    packed = _blocks_of(q, "query_id", "v", d, per_block).toDF("qids", "asked")
    asked = staged(packed.withColumn("block", F.monotonically_increasing_id()), "queries")
    met = _blocks_of(vectors, id_col, vector_col, d, TILE_ROWS).crossJoin(asked)
    hits = met.mapInArrow(_best_of_blocks(k, d, decimals, schema), schema)
    return top_rows(hits, ["query_id"], [F.desc("score"), F.asc(id_col)], k)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    norms[norms == 0] = 1.0
    return m / norms[:, None]


def _best_of_blocks(k: int, d: int, decimals: int, schema: T.StructType, held_rows: int = 2_000_000):
    """Rows (ids, matrix, qids, asked, block) to the best hits of each query in this task.

    ``held_rows`` hits at most are held; beyond that they are given out and only the floors stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []
        best: dict[int, list] = {}
        floors: dict[int, np.ndarray] = {}
        held = 0

        def given():
            for qids, scores, ids in best.values():
                counts = [len(s) for s in scores]
                if sum(counts):
                    yield pa.RecordBatch.from_arrays(
                        [qids.take(pa.array(np.repeat(np.arange(len(qids)), counts))), pa.array(np.concatenate(ids), type=types[1]),
                         pa.array(np.concatenate(scores))],
                        names=schema.names,
                    )
            best.clear()

        for batch in batches:
            types = [batch.column(2).type.value_type, batch.column(0).type.value_type]
            for r in range(batch.num_rows):
                every = np.asarray(batch.column(0)[r].values.to_pandas())
                rows = np.frombuffer(batch.column(1)[r].as_buffer(), np.float64).reshape(-1, d)
                matrix = np.frombuffer(batch.column(3)[r].as_buffer(), np.float64).reshape(-1, d)
                name = batch.column(4)[r].as_py()
                if name not in best:
                    best[name] = [batch.column(2)[r].values, [np.empty(0)] * len(matrix), [every[:0]] * len(matrix)]
                    floors.setdefault(name, np.full(len(matrix), -np.inf))
                _, kept_scores, kept_ids = best[name]
                scores = np.round(matrix @ rows.T, decimals)
                least = floors[name]
                if scores.shape[1] > k:
                    least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
                for j in np.flatnonzero((scores >= least[:, None]).any(axis=1)):
                    near = np.flatnonzero(scores[j] >= least[j])
                    s = np.concatenate([kept_scores[j], scores[j, near]])
                    i = np.concatenate([kept_ids[j], every[near]])
                    top = _best_of(s, i, k)
                    held += len(top) - len(kept_scores[j])
                    kept_scores[j], kept_ids[j] = s[top], i[top]
                    if len(top) == k:
                        floors[name][j] = max(floors[name][j], s[top[-1]])
                if held > held_rows:
                    yield from given()
                    held = 0
        yield from given()

    return run
