"""Exact top-k search by inner product with pivot-table elimination.

Distances of every vector to a few pivots are computed once.  For a query q and
a candidate v the triangle inequality gives, over all pivots p,
``|q - v| >= max |d(q, p) - d(v, p)|``, and with
``q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2`` an upper bound of the score.  Candidates are
scored in the order of their bounds until the next bound lies below the k-th best score.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fathomtext.functions.stats import top_rows
from fathomtext.llm.common import read_table, written


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """``id`` and ``vec``: floor(scale * x) of each component, as longs.

    Null ids, null vectors and vectors with a null, NaN or infinite component are
    left out.  Of rows that share an id the one with the smallest vector counts.
    """
    finite = F.forall(
        vec_col,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return (
        df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
        .select(
            F.col(id_col).cast("long").alias("id"),
            F.transform(vec_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("vec"),
        )
        .groupBy("id")
        .agg(F.min("vec").alias("vec"))
    )


def choose_pivots(vectors: DataFrame, pivots: int, sample: int) -> dict[int, np.ndarray]:
    """Far-apart vectors of a bounded sample, for each vector length in it.

    Pivots only affect how much is skipped, never the result; a length without
    pivots is searched in full.
    """
    rows = vectors.orderBy(F.xxhash64("vec"), "id").limit(sample).select("vec").collect()
    by_length: dict[int, list] = {}
    for row in rows:
        by_length.setdefault(len(row["vec"]), []).append(row["vec"])
    out = {}
    for length, vecs in by_length.items():
        x = np.array(vecs, dtype=np.float64).reshape(len(vecs), length)
        chosen = [0]
        far = ((x - x[0]) ** 2).sum(axis=1)
        while len(chosen) < min(pivots, len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        out[length] = x[chosen]
    return out


def _with_pivot_distances(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds the squared norm and the distances to the pivots."""

    def measure(batches):
        for pdf in batches:
            norm, dist = [], []
            for vec in pdf["vec"]:
                x = np.asarray(vec, dtype=np.float64)
                norm.append(float(x @ x))
                p = pivots.get(len(x))
                dist.append([] if p is None else np.sqrt(((p - x) ** 2).sum(axis=1)))
            yield pdf.assign(norm=norm, dist=dist)

    return vectors.mapInPandas(measure, "id long, vec array<long>, norm double, dist array<double>")


def search_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of this block for each query."""
    out: list[tuple[int, int, int]] = []
    if not len(queries) or not len(candidates):
        return out
    candidates = candidates.sort_values("id", ignore_index=True)
    ids = candidates["id"].to_numpy(np.int64)
    x = np.stack([np.asarray(v, dtype=np.int64) for v in candidates["vec"]])
    norms = candidates["norm"].to_numpy()
    table = np.ascontiguousarray(np.stack([np.asarray(v, dtype=np.float64) for v in candidates["dist"]]).T)
    n = len(ids)
    for qid, qvec, qnorm, qdist in zip(queries["id"], queries["vec"], queries["norm"], queries["dist"]):
        q = np.asarray(qvec, dtype=np.int64)
        low = np.zeros(n)
        for p, d in enumerate(qdist):
            np.maximum(low, np.abs(table[p] - d), out=low)
        # The slack covers the rounding of square roots and sums.
        upper = (qnorm + norms - low * low) / 2 + 1e-6 * (1 + qnorm + norms)
        upper[ids == qid] = -np.inf
        best_score = np.empty(0, np.int64)
        best_id = np.empty(0, np.int64)
        done, step, left = 0, 128, np.arange(n)
        while len(left):
            # The highest bounds still left, about ``step`` of them.
            if len(left) > step:
                take = np.argpartition(-upper[left], step - 1)[:step]
                chunk = left[take]
                keep = np.ones(len(left), bool)
                keep[take] = False
                left = left[keep]
            else:
                chunk, left = left, left[:0]
            chunk = chunk[upper[chunk] > -np.inf]
            scores = np.concatenate([best_score, x[chunk] @ q])
            owners = np.concatenate([best_id, ids[chunk]])
            order = np.lexsort((owners, -scores))[:k]
            best_score, best_id = scores[order], owners[order]
            done += len(chunk)
            if len(best_score) == k and len(left):
                left = left[upper[left] >= best_score[-1]]
            step *= 2
        out.extend((int(qid), int(i), int(s)) for i, s in zip(best_id, best_score))
    return out


def exact_topk(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    query_if: Column,
    k: int = 5,
    pivots: int = 24,
    pivot_sample: int = 2000,
    candidate_rows: int = 4096,
    query_rows: int = 2048,
) -> DataFrame:
    """The k highest integer inner products of each query over all other rows.

    ``query_if`` is a condition on ``id``.  Queries and candidates meet in blocks of
    bounded size, each block pair being one group; only k rows a query leave it.

    Defined cases: see :func:`integer_vectors` for rows without a usable vector.  A
    candidate is never the query's own id; ties go to the smaller id; a query with
    fewer than k candidates gets all of them; vectors of another length than the
    query's are no candidates; an empty table gives no rows.  Other columns of the
    table are ignored.  Scores are exact while they fit into 63 bits.
    """
    vectors = written(integer_vectors(df, id_col, vec_col))
    n = vectors.count()
    n_queries = vectors.where(query_if).count()
    table = written(
        _with_pivot_distances(vectors, choose_pivots(vectors, pivots, pivot_sample)).withColumn("len", F.size("vec"))
    )
    c_blocks, q_blocks = max(1, math.ceil(n / candidate_rows)), max(1, math.ceil(n_queries / query_rows))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    block = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = table.where(query_if).withColumn("qb", block(q_blocks)).withColumn("cb", every(c_blocks))
    right = table.withColumn("cb", block(c_blocks)).withColumn("qb", every(q_blocks))

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(search_block(queries, candidates, k), columns=["query_id", "vec_id", "score"])

    found = (
        left.groupBy("len", "cb", "qb")
        .cogroup(right.groupBy("len", "cb", "qb"))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    return top_rows(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    return exact_topk(
        read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0, k=5
    )


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
