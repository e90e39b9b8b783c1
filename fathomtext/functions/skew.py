"""Joins that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


#: Rows of one key that a task should meet at most.
ROWS_PER_TASK = 200_000


def hot_keys(df: DataFrame, keys: list[str], rows: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than ``rows`` rows and ``_salts``, the tasks to spread each over.

    There is at most one such key for every ``rows`` rows of the table, so the list of a
    table of 10^11 rows has at most 500,000 entries of a key and a number.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > rows).select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_salts"))


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread_by: str,
    how: str = "inner",
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join a large table to one row (or few rows) per key.

    Rows of a hot key are spread by a hash of ``spread_by`` over as many salts as its number of
    rows asks for; only the lookup rows of those keys are repeated.
    """
    hot = hot_keys(df, keys, rows)
    salts = F.coalesce("_salts", F.lit(1))
    left = (
        df.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int"))
        .drop("_salts")
    )
    right = (
        lookup.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def salted_terms(df: DataFrame, spread_by: str, salts: int) -> DataFrame:
    """Add the salt column of the large side of a salted join."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))


def repeated_for_salts(df: DataFrame, salts: int) -> DataFrame:
    """Repeat a small side once per salt."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
