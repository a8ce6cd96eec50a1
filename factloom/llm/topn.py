"""The N best items of every group, whatever the groups' sizes.

Per-group histograms of the score give a lower threshold above which at least N items lie; rows
below it are dropped before any ranking, and the rest is ranked exactly with the tie keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.columns import fresh
from factloom.operators.skew import fragment_replicate_join
from factloom.session import cut

#: Steps of a histogram; a group has one more bucket than steps at most.
STEPS = 1_024


def bucket(score: Column, low: float = 0.0, high: float = 1.0, steps: int = STEPS) -> Column:
    """The bucket of a score: never falls as the score rises; scores beyond the range share the outer buckets."""
    return F.greatest(F.lit(0), F.least(F.lit(steps), F.floor((score - low) / (high - low) * steps))).cast("int")


def thresholds(rows: DataFrame, keys: Sequence[str], bucket_col: str, n: int) -> DataFrame:
    """(keys, least, load) per group: the highest bucket at and above which at least n rows lie, and all rows.

    Counts are combined before the shuffle, and a group has at most STEPS + 1 of them.
    """
    hist = rows.groupBy(*keys, F.col(bucket_col).alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    above = F.sum("__c").over(W.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, 0))
    return hist.withColumn("__above", above).groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("__above") >= n, F.col("__b"))), F.min("__b")).alias("least"), F.sum("__c").alias("load")
    )


def survivors(rows: DataFrame, keys: Sequence[str], bucket_col: str, n: int, extra: DataFrame | None = None, spread_by: Sequence[str] = ()) -> DataFrame:
    """Rows at or above their group's threshold, with the columns that `extra` has for the group (inner).

    A superset of the n best of each group under any tie keys.  Rows with a null key have no group.
    The rows are read twice: give a cut table.  spread_by: see fragment_replicate_join.
    """
    known = cut(thresholds(rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)), keys, bucket_col, n))
    limit = known.select(*keys, "least")
    if extra is not None:
        limit = limit.join(extra, list(keys))
    out = fragment_replicate_join(rows, limit, keys, loads=known.select(*keys, "load"), spread_by=spread_by)
    least = "least" if "least" not in rows.columns else next(c for c in out.columns if c.startswith("least_right"))
    return out.where(F.col(bucket_col) >= F.col(least)).drop(least)


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, place: str = "place") -> DataFrame:
    """The first n rows of each group by the order, with their place; the limit is applied before the shuffle too."""
    p = fresh(place, rows)
    return rows.withColumn(p, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(p) <= n)


def top_n(rows: DataFrame, keys: Sequence[str], score: str, ties: Sequence[Column], n: int, place: str = "place") -> DataFrame:
    """The n best rows of each group: score descending, then the tie keys; with their place from 1.

    Rows whose score is null or NaN, or that lack a key, have no place and are left out.  Repeated
    rows are ranked each; groups of fewer than n rows come out whole; an empty table gives no rows.
    """
    ok = rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    span = ok.agg(F.min(score).cast("double"), F.max(score).cast("double")).first()
    low, high = (span[0], span[1]) if span[0] is not None and span[1] > span[0] else (0.0, 1.0)
    b = fresh("__bucket", rows)
    kept = survivors(cut(ok.withColumn(b, bucket(F.col(score).cast("double"), low, high))), keys, b, n).drop(b)
    return ranked(kept, keys, [F.col(score).desc(), *ties], n, place)
