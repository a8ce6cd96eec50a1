"""A score cutoff per source that keeps a target fraction of its records.

Sketch-bracketed exact selection: quantile sketches of guaranteed rank error bracket the cutoff,
records above the bracket are counted, and only the bracketed ones are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.skew import is_small, lookup_join
from factloom.session import cut

#: A sketch answers at these many even steps, each within n / ACCURACY ranks.
STEPS, ACCURACY = 64, 2_000
#: Distinct scores of one source that may be sorted in one task; above it, the bracket is narrowed again.
SORTED_VALUES = 200_000


def _bracket(rows: DataFrame) -> DataFrame:
    """(g, k, lo, hi): bounds that enclose the k-th highest score of each group.  rows: g, s, k."""
    grid = [i / STEPS for i in range(STEPS + 1)]
    sk = rows.groupBy("g").agg(
        F.percentile_approx("s", [float(p) for p in grid], ACCURACY).alias("v"), F.count(F.lit(1)).alias("n"), F.min("k").alias("k")
    )
    e = 2.0 / ACCURACY
    at = F.arrays_zip(F.array(*map(F.lit, grid)).alias("p"), F.col("v"))
    rank = F.col("n") - F.col("k") + 1  # from below, from 1
    low = F.array_max(F.transform(F.filter(at, lambda x: (x["p"] + e) * F.col("n") <= rank - 1), lambda x: x["v"]))
    high = F.array_min(F.transform(F.filter(at, lambda x: (x["p"] - e) * F.col("n") >= rank + 1), lambda x: x["v"]))
    return sk.select("g", "k", F.coalesce(low, F.lit(float("-inf"))).alias("lo"), F.coalesce(high, F.lit(float("inf"))).alias("hi"))


def _values(rows: DataFrame, bracket: DataFrame, small: bool) -> DataFrame:
    """Counts by score inside the bracket; scores above it count under one mark each: (g, k, above, s, c)."""
    b = bracket.select("g", "lo", "hi")
    placed = lookup_join(rows, b, ["g"], small=small)
    kept = placed.where(F.col("s") >= F.col("lo")).select("g", "k", (F.col("s") > F.col("hi")).alias("above"), F.when(F.col("s") <= F.col("hi"), F.col("s")).alias("s"))
    return kept.groupBy("g", "k", "above", "s").agg(F.count(F.lit(1)).alias("c"))


def cutoffs(records: DataFrame, group: str, score: str, targets: DataFrame, target_group: str, fraction: str) -> DataFrame:
    """(group, cutoff, kept, scored, fraction): the largest cutoff that keeps at least the fraction of each group.

    Scores that are null or NaN aren't counted.  Groups without a target or without scored records
    give no row; of several targets of a group the largest counts; a null fraction is no target.
    Fractions are taken as 0..1; one record is kept at least.  Ties at the cutoff are all kept.
    Other columns, whatever their names, aren't read.
    """
    t = targets.select(F.col(target_group).alias("g"), F.col(fraction).cast("double").alias("f")).where("g IS NOT NULL AND f IS NOT NULL").groupBy("g").agg(F.least(F.greatest(F.max("f"), F.lit(0.0)), F.lit(1.0)).alias("f"))
    t = cut(t)
    small = is_small(t.select("g", "f", F.lit(0.0).alias("a"), F.lit(0.0).alias("b")))  # what is joined below has a row per target and as many columns at most
    s = F.col(score).cast("double")
    rows = lookup_join(records.select(F.col(group).alias("g"), F.when(~F.isnan(s), s).alias("s")).where("g IS NOT NULL AND s IS NOT NULL"), t, ["g"], small=small)
    rows = cut(rows)
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("scored"), F.min("f").alias("f"))
    need = F.greatest(F.lit(1), F.ceil(F.col("f").cast("decimal(18,15)") * F.col("scored"))).cast("bigint")
    sizes = cut(sizes.select("g", "scored", "f", need.alias("k")))
    inside = lookup_join(rows.select("g", "s"), sizes.select("g", "k"), ["g"], small=small).select("g", "s", "k")
    done_above = None
    while True:
        values = cut(_values(inside, _bracket(inside), small))
        above = values.where("above").groupBy("g").agg(F.sum("c").alias("a"))
        widest = values.where("NOT above").groupBy("g").count().agg(F.max("count")).first()[0]
        if widest is None or widest <= SORTED_VALUES:
            break
        # narrow once more: what lies above is counted, what is left is ranked among itself
        done_above = above if done_above is None else done_above.union(above).groupBy("g").agg(F.sum("a").alias("a"))
        keep = _bracket(inside).select("g", "lo", "hi")
        nxt = lookup_join(lookup_join(inside, keep, ["g"], small=small), above, ["g"], "left", small=small)
        inside = cut(nxt.where("s >= lo AND s <= hi").select("g", "s", (F.col("k") - F.coalesce("a", F.lit(0))).alias("k")))
    order = W.partitionBy("g").orderBy(F.col("s").desc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    ranked = values.withColumn("cum", F.sum("c").over(order)).where("NOT above AND cum >= k")
    found = ranked.groupBy("g").agg(F.max_by("s", "s").alias("cutoff"), F.min("cum").alias("kept"))
    if done_above is not None:
        found = found.join(done_above, "g", "left").select("g", "cutoff", (F.col("kept") + F.coalesce("a", F.lit(0))).alias("kept"))
    out = sizes.join(found, "g")
    return out.select(F.col("g").alias(group), "cutoff", "kept", "scored", F.col("f").alias("fraction"))


def valid_interest(c: Column) -> Column:
    """An interest score from 0 to 10, else null."""
    return F.when(c.between(0, 10), c)
