"""A keyed store of findings as pure functions of the old table and a change."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, score: str, touched: Sequence[str]) -> DataFrame:
    """Monotone upsert, one row per key: new keys come in; a higher score replaces the row; else only `touched` columns change.

    Equal scores take the metadata branch; there a null of the new row overwrites.  A null stored score
    counts as 0.  The new table needs one row per key (see folded()).
    """
    o, n = old.alias("o"), new.alias("n")
    has_old, has_new = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    wins = has_new & (~has_old | (F.coalesce(F.col(f"n.{score}"), F.lit(0.0)) > F.coalesce(F.col(f"o.{score}"), F.lit(0.0))))

    def pick(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
        if c in touched:
            return F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        return F.when(wins, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*[pick(c) for c in old.columns])


def folded(batch: DataFrame, key: str, score: str, order: str, touched: Sequence[str]) -> DataFrame:
    """One row per key, as if the batch's rows had been upserted one by one: the first of the highest scores, with the last row's touched columns."""
    cols = [c for c in batch.columns if c != key]
    s = F.coalesce(F.col(score), F.lit(0.0))
    best = F.max_by(F.struct(*cols), F.struct(s, -F.col(order)))
    last = F.max_by(F.struct(*[F.col(c) for c in touched]), F.col(order)) if touched else None
    g = batch.groupBy(key).agg(best.alias("b"), *([last.alias("l")] if touched else []))
    return g.select(*[F.col(key) if c == key else (F.col(f"l.{c}") if c in touched else F.col(f"b.{c}")).alias(c) for c in batch.columns])


def verified(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Set verification_status and raise score to the greater one for the keys of `changes` (key, verification_status, score)."""
    c = changes.select(F.col(key), F.col("verification_status").alias("__s"), F.col("score").alias("__c"), F.lit(True).alias("__hit"))
    j = old.join(c, key, "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    return j.withColumn("verification_status", F.when(hit, F.col("__s")).otherwise(F.col("verification_status"))).withColumn(
        "score", F.when(hit & F.col("__c").isNotNull(), F.greatest("score", "__c")).otherwise(F.col("score"))
    ).select(*old.columns)


def overwritten(old: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns taken from `changes` where it has a value for the key."""
    c = changes.select(key, *[F.col(x).alias(f"__{x}") for x in columns])
    return old.join(c, key, "left").select(*[F.coalesce(F.col(f"__{x}"), F.col(x)).alias(x) if x in columns else F.col(x) for x in old.columns])


def purged(old: DataFrame, updated: str, before: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows last updated before the instant go; rows without an instant stay."""
    gone = F.coalesce(F.col(updated) < before, F.lit(False))
    return old.where(~gone), old.where(gone)


def merged(parts: Sequence[DataFrame]) -> DataFrame:
    """Outputs of several scanners in one table; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def path_signature(path: Column) -> Column:
    """16 hex digits for a path, the same for any order of its nodes."""
    return F.substring(F.sha2(F.array_join(F.array_sort(path), "|"), 256), 1, 16)


def top_paths(findings: DataFrame, key: str, signature: str, score: str, tie: str, most: int = 3) -> DataFrame:
    """Per key the best row of each path, and of those at most `most`."""
    order = [F.col(score).desc_nulls_last(), F.col(tie)]
    one = findings.withColumn("__r", F.row_number().over(W.partitionBy(key, signature).orderBy(*order))).where("__r = 1")
    return one.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def latest(df: DataFrame, key: Sequence[str], when: str, tie: str) -> DataFrame:
    """The last row of each key by time, then tie; rows without a time come first."""
    cols = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(F.col(when), F.col(tie))).alias("b"))
    return g.select(*key, *[F.col(f"b.{c}").alias(c) for c in cols])
