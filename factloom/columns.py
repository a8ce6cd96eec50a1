"""Small helpers on columns that several operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(base: str, *taken: DataFrame | Iterable[str]) -> str:
    """A column name that no given table has (case-insensitively)."""
    used = {c.lower() for t in taken for c in (t.columns if isinstance(t, DataFrame) else t)}
    name, i = base, 0
    while name.lower() in used:
        i += 1
        name = f"{base}_{i}"
    return name


def own_prefix(*tables: DataFrame) -> str:
    """A prefix that no column of the tables begins with, for an operator's own columns."""
    used = [c.lower() for t in tables for c in t.columns]
    i = 0
    while any(c.startswith(f"__{i}_") for c in used):
        i += 1
    return f"__{i}_"


def is_blank(c: Column) -> Column:
    """Null, empty, or only white space."""
    return c.isNull() | ~c.rlike(r"\S")


def unit_number(c: Column) -> Column:
    """The value if it is a number from 0 to 1, else null (NaN counts as no number)."""
    return F.when((c >= 0) & (c <= 1) & ~F.isnan(c), c)


def computed(df: DataFrame, keep: Iterable[str], **exprs: Column) -> DataFrame:
    """The kept columns and new ones, each computed once per row.

    A filter or join on a plain projected column makes the optimizer repeat its whole expression below;
    it can't do so with what a generator gives out.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))


def table(spark, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
