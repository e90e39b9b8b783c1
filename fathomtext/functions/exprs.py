"""Small helpers for building column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Characters Python's str.strip() removes, without line ends.
BLANKS = " \t\u00a0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and let ``body`` use it any number of times.

    Catalyst may inline a projected column into a lambda that runs once per
    array element; a value bound to a lambda variable cannot be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def lstrip_blanks(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def append(items: Column, item: Column) -> Column:
    return F.concat(items, F.array(item))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def empty_array(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def null_as(data_type: str) -> Column:
    return F.lit(None).cast(data_type)


def keep_last_entries(entries: Column) -> Column:
    """One entry per key: place of the first occurrence, value of the last."""
    return bind(
        entries,
        lambda es: F.transform(
            F.array_distinct(F.transform(es, lambda e: e["key"])),
            lambda k: F.struct(
                k.alias("key"),
                F.element_at(F.filter(es, lambda e: e["key"] == k), -1)["value"].alias("value"),
            ),
        ),
    )


def clip(c: Column, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(c, 1, n)
