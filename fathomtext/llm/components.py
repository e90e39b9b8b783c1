"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomtext.llm.common import written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star operation over (u, v) with u != v; every neighbour is pointed at a minimum.

    Large-star looks at all neighbours of a node and moves the larger ones, small-star
    at the smaller ones and the node itself.  The minimum of a node is a partial
    aggregation, and its neighbours meet it by a join whose hot keys can be split.
    """
    if small:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if small:
        out = around.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(low.select("u", F.col("m").alias("v")))
    else:
        out = around.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # Repeated edges do no harm inside a round; the small star ends it.
    out = out.where(F.col("u") != F.col("v"))
    return out.distinct() if small else out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each round writes its edges, so a lost executor repeats one round at most.  The
    rounds end when the edges stay the same, which the driver sees from a count and a
    checksum.
    """
    clean = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    current = written(clean.where(F.col("u") != F.col("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        current = written(_stars(_stars(current, small=False), small=True))
        seen = current.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
