"""Intermediate results as tables in the shared folder of the session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from fathomtext.session import ensure_checkpoint_dir


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """The rows written once and read back: later steps neither repeat the work nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
