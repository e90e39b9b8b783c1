"""All registered queries and the SQL that states the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fathomtext.registered.inputs import plain_types

FAMILIES = ("retrieval", "corpus", "quality", "packs", "views", "versions")


def _typed(run):
    @wraps(run)
    def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain_types(run(spark, sf_dir))

    return wrapped


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for family in FAMILIES:
        module = importlib.import_module(f"fathomtext.registered.{family}")
        out.update({name: _typed(f) for name, f in module.QUERIES.items()})
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for family in FAMILIES:
        out.update(importlib.import_module(f"fathomtext.registered.{family}_sql").SQL)
    return out
