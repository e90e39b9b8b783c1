"""Mixing sources to target weights by capped water-filling.

Sources get shares of all words by weight.  A source stops at ``max_epochs`` times its
own size; what it leaves is shared among the others by weight, again and again, until
none is above.  Every source is then repeated whole as often as its target allows, and
a seeded part of its documents once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomtext.llm.common import read_table, word_count, written

WEIGHTS = (5, 2, 1)
#: Documents of a source that are ordered together; a hot source has as many slices as it needs.
SLICE = 2_000


def source_order(sizes: DataFrame, span: int = 4096) -> DataFrame:
    """Adds ``place``: the position of each source by code point, from 0, null last.

    Sources are numbered inside the groups that share their first two characters
    and shifted by the counts of the groups before; a longer list of sources
    than one task should sort stays spread over those groups.
    """
    lead = F.struct(F.col("source").isNull().alias("none"), F.substring("source", 1, 2).alias("head"))
    led = sizes.withColumn("_lead", lead)
    before = Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        led.groupBy("_lead")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_lead", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_lead").orderBy(F.asc_nulls_last("source"))
    return (
        led.withColumn("_at", F.row_number().over(inside) - 1)
        .join(counts, led["_lead"].eqNullSafe(counts["_lead"]))
        .select(*sizes.columns, (F.col("_before") + F.col("_at")).alias("place"))
    )


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Adds ``target`` to one row per source (``source_size``, ``weight``).

    All sums are integers, so the comparison of a share with its cap is exact.  Each
    round is one aggregation to a single row; the driver sees totals only.
    """
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    cap = F.col("source_size") * F.lit(max_epochs)
    big = lambda c: c.cast("decimal(38,0)")
    free_words, free_weight = int(total), None
    clamped = F.lit(False)
    while True:
        row = sources.agg(
            F.sum(F.when(clamped, cap)).alias("c"),
            F.sum(F.when(~clamped, F.col("weight"))).alias("w"),
            F.count(F.when(clamped, True)).alias("n"),
        ).first()
        if free_weight is not None and row["n"] == at:
            break
        at = row["n"]
        free_words, free_weight = int(total) - int(row["c"] or 0), int(row["w"] or 0)
        if not free_weight:
            break
        # A share above the cap: free_words * weight / free_weight > cap.
        clamped = big(cap) * F.lit(free_weight) < big(F.col("weight")) * F.lit(free_words)
    share = F.col("weight") * F.lit(float(free_words)) / F.lit(float(free_weight or 1))
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(share))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = 3,
    seed: int = 17,
    size: Column | None = None,
) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` and ``repeats``.

    ``repeats`` is how often the mix takes the document: the whole part of
    target / source size for each document, and once more for those whose middle
    lies below the fractional part when a source is laid out in seeded order, so a
    source misses its target by at most half a document.

    Defined cases: a null text has size 0; null sources form one source, last in
    order; a source without words has target 0 and repeats 0; documents of size 0 in
    other sources are repeated like the rest and add no words; repeated rows are
    drawn independently of each other; equal order keys are equal rows, so reruns
    agree; an empty table gives no rows.  All columns of the input are kept;
    helper columns begin with ``_mix``, and input columns named like a result
    (size, source_size, target, repeats) are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "repeats")
    sized = docs.withColumn("size", word_count(F.col("text")) if size is None else size)
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id"), F.xxhash64("text"), F.col("size")]
    rank = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1)
    # One row per source and slice of the seeded order, before anything is joined.
    small = sized.select("source", "size", rank.alias("_mix_rank"))
    per_source = written(
        small.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_mix_n"))
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = written(source_order(per_source).withColumn("weight", weight.cast("long")))
    targets = written(
        water_fill(weighed, max_epochs)
        .withColumn("_mix_slices", F.ceil(F.col("_mix_n") / SLICE))
        .select(F.col("source").alias("_mix_source"), "source_size", "target", "_mix_slices")
    )
    slot = F.floor(F.col("_mix_rank") / F.lit(2.0**63) * F.col("_mix_slices")).cast("long").alias("_mix_slot")
    met = sized.withColumn("_mix_rank", rank).join(targets, F.col("source").eqNullSafe(F.col("_mix_source")))
    slots = (
        small.join(targets, F.col("source").eqNullSafe(F.col("_mix_source")))
        .groupBy("_mix_source", slot)
        .agg(F.sum("size").alias("_mix_words"))
    )
    upto = Window.partitionBy("_mix_source").orderBy("_mix_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.select(
        F.col("_mix_source").alias("_mix_s"),
        F.col("_mix_slot").alias("_mix_k"),
        F.coalesce(F.sum("_mix_words").over(upto), F.lit(0)).alias("_mix_before"),
    )
    inside = Window.partitionBy("_mix_source", "_mix_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio)
    middle = F.col("_mix_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    extra = F.when(middle < (ratio - whole) * F.col("source_size"), 1).otherwise(0)
    placed = met.withColumn("_mix_slot", slot)
    return (
        placed.join(
            offsets,
            F.col("_mix_source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_slot") == F.col("_mix_k")),
        )
        .withColumn("repeats", (whole + extra).cast("int"))
        .select(*docs.columns, "size", "source_size", "target", "repeats")
    )


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    # The words are counted once; the texts stay where they are.
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("text")))
    return mix_sources(sizes, size=F.col("words")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("repeats") * F.col("size")).cast("long").alias("taken"),
    )
