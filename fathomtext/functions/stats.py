"""Exact order statistics that never gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomtext.sources.staging import staged


def nearest_rank(
    df: DataFrame,
    groups: list[str],
    value: str,
    points: dict[str, float],
    buckets: int = 4096,
    levels: int = 5,
    slice_rows: int = 200_000,
) -> DataFrame:
    """Value at sorted position ``min(floor(n * p), n - 1)`` per group.

    Equal values are counted first (with a map-side combine).  Each level then
    splits the remaining range of a group into linear buckets, adds up bucket
    counts and keeps only the bucket that holds the wanted position, until no group has more
    than ``slice_rows`` values left, which are then ranked.  Five levels cut a range
    2^60-fold, so the last step sees a small slice however skewed the values are.
    """
    if not groups:
        # One global group still needs a key to meet its targets on.
        return nearest_rank(
            df.withColumn("_one", F.lit(1)), ["_one"], value, points, buckets, levels, slice_rows
        ).drop("_one")
    counted = staged(
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n")),
        "values",
    )
    wanted = F.array(
        *[F.struct(F.lit(name).alias("point"), F.lit(float(p)).alias("p")) for name, p in points.items()]
    )
    keys = [*groups, "_point"]
    targets = (
        counted.groupBy(*groups)
        .agg(F.sum("_n").alias("_total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_w", F.explode(wanted))
        .select(
            *groups,
            F.col("_w.point").alias("_point"),
            F.least(F.floor(F.col("_total") * F.col("_w.p")), F.col("_total") - 1).alias("_rank"),
            "_lo",
            "_hi",
        )
    )
    widest = lambda rows, by: rows.groupBy(*by).count().agg(F.max("count").alias("n")).first()["n"] or 0
    slice_of, rows = counted.join(targets, groups), widest(counted, groups)
    for _ in range(levels):
        if rows <= slice_rows:
            break
        width = (F.col("_hi") - F.col("_lo")) / F.lit(float(buckets))
        b = F.when(
            F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / width)
        ).otherwise(F.lit(0)).cast("long")
        bucketed = slice_of.withColumn("_b", b)
        sums = bucketed.groupBy(*keys, "_b", "_rank").agg(
            F.sum("_n").alias("_bn"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi")
        )
        upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        hit = (
            sums.withColumn("_before", F.coalesce(F.sum("_bn").over(upto), F.lit(0)))
            .where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_bn")))
            .select(*keys, "_b", (F.col("_rank") - F.col("_before")).alias("_rank2"), "_blo", "_bhi")
        )
        slice_of = staged(
            bucketed.join(hit, [*keys, "_b"])
            .select(
                *keys, "_v", "_n",
                F.col("_rank2").alias("_rank"), F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"),
            ),
            "values",
        )
        rows = widest(slice_of, keys)
    order = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    picked = slice_of.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).where(
        (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
    )
    return picked.groupBy(*groups).agg(
        *[F.max(F.when(F.col("_point") == name, F.col("_v"))).alias(name) for name in points]
    )


def top_rows(df: DataFrame, groups: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per group with their rank.

    Spark plans the filter on ``row_number`` as a group limit on both sides of
    the shuffle, so at most ``k`` rows per group leave a task.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def numbered(df: DataFrame, groups: list[str], seq: str, out: str, span: int = 100_000) -> DataFrame:
    """Position of each row in its group by an integer sequence, from 1.

    The sequence is unique in the group, so a slice of ``span`` values holds at
    most ``span`` rows: rows are numbered inside slices and shifted by the
    counts of the slices before.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(seq) / span))
    counts = sliced.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_slice", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, "_slice").orderBy(seq)
    return (
        sliced.withColumn("_at", F.row_number().over(inside))
        .join(offsets, [*groups, "_slice"])
        .withColumn(out, F.col("_before") + F.col("_at"))
        .drop("_slice", "_at", "_before")
    )
