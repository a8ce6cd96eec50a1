"""Filters, joins, aggregations, rankings and set operations over fact tables.

Every function takes and returns DataFrames or Columns and leaves the physical plan to the optimizer.
Limits and first-row choices carry a unique tie-break, so results don't depend on the scan order.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.columns import fresh
from factloom.operators.skew import lookup_join
from factloom.session import cut

# ---------------------------------------------------------------- filters


def equals_text(c: Column, value: str, ignore_case: bool = True) -> Column:
    return F.lower(c) == value.lower() if ignore_case else c == value


def contains_text(c: Column, value: str, ignore_case: bool = True) -> Column:
    """Substring test; the value's % and _ are plain characters."""
    return F.contains(F.lower(c), F.lit(value.lower())) if ignore_case else F.contains(c, F.lit(value))


def like_text(c: Column, pattern: str) -> Column:
    """LIKE with the caller's wildcards live, in any case."""
    return c.ilike(pattern)


def escape_like(value: str) -> str:
    """A text whose LIKE pattern matches only itself."""
    return re.sub(r"([\\%_])", r"\\\1", value)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def function_filter(
    df: DataFrame,
    name: str | None = None,
    signature: str | None = None,
    has_code: bool | None = None,
    has_dangerous: bool | None = None,
    order_by: str = "function_id",
    ascending: bool = True,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Conjunctive filter with optional parts, ordered by a column of the table and paged."""
    if order_by not in df.columns:
        raise ValueError(f"no column {order_by}")
    parts = []
    if name:
        parts.append(contains_text(F.col("function_name"), name))
    if signature:
        parts.append(contains_text(F.col("function_signature"), signature))
    if has_code is not None:
        code = F.coalesce(F.col("decompiled_code"), F.lit("")) != ""
        parts.append(code if has_code else ~code)
    if has_dangerous is not None:
        risky = F.size("dangerous") > 0
        parts.append(risky if has_dangerous else ~risky)
    first = F.col(order_by).asc_nulls_first() if ascending else F.col(order_by).desc_nulls_last()
    out = df.where(all_of(parts)).orderBy(first, "module", "function_id")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def by_filters(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """column = value for each entry; unknown columns are refused, and no entries give no rows."""
    unknown = [c for c in filters if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    return df.where(all_of([F.col(c) == F.lit(v) for c, v in filters.items()]) if filters else F.lit(False))


def in_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is listed; keys not found are skipped."""
    return lookup_join(df, keys.select(*on).distinct(), on, "left_semi")


def not_in_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return lookup_join(df, keys.select(*on).distinct(), on, "left_anti")


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) that touch none of the nodes (column 'node')."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_anti").join(n.withColumnRenamed("node", "dst"), "dst", "left_anti")


def one_column(df: DataFrame, name: str) -> DataFrame:
    """One column by name, refused if the table has none."""
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df.select(name)


#: Words that a read-only statement may not hold outside literals and comments.
WRITE_WORDS = ("insert", "update", "delete", "drop", "alter", "create", "replace", "truncate", "attach", "detach", "merge", "reindex", "vacuum")


def read_only_sql(statement: str, select_only: bool = True) -> str:
    """The statement, if it only reads; else ValueError."""
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/", " ", statement, flags=re.S)
    if m := re.search(r"\b(" + "|".join(WRITE_WORDS) + r")\b", bare, re.I):
        raise ValueError(f"{m.group(1)} isn't allowed")
    if ";" in bare.strip().rstrip(";"):
        raise ValueError("one statement only")
    if select_only and not re.match(r"\s*(select|with)\b", bare, re.I):
        raise ValueError("only SELECT is allowed")
    return statement


def safe_select(spark: SparkSession, statement: str, args: Mapping[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """Run a statement that was checked to only read, with named parameters and tables ({name} in the statement)."""
    return spark.sql(read_only_sql(statement), args=dict(args or {}), **tables)


# ---------------------------------------------------------------- pages and top rows


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 100) -> tuple[DataFrame, int]:
    """(rows of a page, number of all rows); numbers below 1 mean 1, sizes below 1 mean 100."""
    number, size = max(1, number), size if size >= 1 else 100
    return df.orderBy(*order).offset((number - 1) * size).limit(size), df.count()


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Ranks 1..N over the whole table, ties by the order's last keys.

    Rows are sorted over all tasks; each range's offset is added to ranks inside the range, so no
    task sees the whole table.
    """
    spark = df.sparkSession
    p, i = fresh("__p", df), fresh("__i", df)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(i, F.monotonically_increasing_id())
    sorted_ = sorted_.withColumn(p, F.shiftright(F.col(i), 33))
    sorted_ = cut(sorted_)
    sizes = sorted_.groupBy(p).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy(p).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row per task
    out = sorted_.join(F.broadcast(before.select(p, "__before")), p)
    return out.select(*df.columns, (F.col(i).bitwiseAND((1 << 33) - 1) + F.col("__before") + 1).alias(name))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Places 1..N of a table that a report's limit has made short; for whole tables see ranked()."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)))


def batched(df: DataFrame, order: Sequence[Column], size: int, name: str = "batch") -> DataFrame:
    """Batch numbers from 0 of so many rows each, by a total order; no task sees the whole table."""
    i = fresh("__rank", df)
    return ranked(df, order, i).withColumn(name, F.expr(f"({i} - 1) div {int(size)}")).drop(i)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by the order."""
    r = fresh("__r", df)
    return df.withColumn(r, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(r) == 1).drop(r)


def top_distinct(df: DataFrame, key: Sequence[str], signature: str, order: Sequence[Column], most: int) -> DataFrame:
    """Per key, the best row of each signature, and of those at most `most`, best first."""
    r, s = fresh("__r", df), fresh("__s", df)
    firsts = df.withColumn(r, F.row_number().over(W.partitionBy(*key, signature).orderBy(*order))).where(F.col(r) == 1)
    return firsts.withColumn(s, F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col(s) <= most).drop(r, s)


def first_by_priority(df: DataFrame, key: Sequence[str], priority: str, notes: str) -> DataFrame:
    """One row per key, of the least priority, with the notes of all its rows joined in priority order."""
    cols = [c for c in df.columns if c not in (*key, priority, notes)]
    best = F.min_by(F.struct(*cols), priority) if cols else None
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(priority, notes))), lambda x: x[notes]), "; ")
    out = df.groupBy(*key).agg(F.min(priority).alias(priority), *([best.alias("__b")] if cols else []), told.alias(notes))
    return out.select(*key, priority, *[F.col(f"__b.{c}").alias(c) for c in cols], notes)


def share_of_max(df: DataFrame, value: str, within: Sequence[str], name: str) -> DataFrame:
    """value / max(value) within the keys; a maximum of 0 counts as 1."""
    m = F.max(value).over(W.partitionBy(*within))
    return df.withColumn(name, F.col(value) / F.when(m == 0, 1).otherwise(m))


def adaptive_limit(rows: int, least: int, most: int, base: int = 5, per_hundred: int = 1, entries: int = 0) -> int:
    """A report's length from the number of rows: base + rows/100 * k between bounds, raised to cover half the entries."""
    return max(min(most, max(least, base + rows // 100 * per_hundred)), min(most, (entries + 1) // 2))


# ---------------------------------------------------------------- aggregations


def conditional_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows that meet each condition, and of all rows."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def domain_counts(df: DataFrame, column: str, domain: Sequence[str], name: str = "n") -> DataFrame:
    """A count for each value of a fixed domain, zeros included; other values aren't counted."""
    spark = df.sparkSession
    fixed = spark.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = df.where(F.col(column).isin(list(domain))).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return fixed.join(F.broadcast(counts), column, "left").fillna(0, [name])  # as many rows as the domain


def two_way_summary(df: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Rows and best score in all, per value of a, and per value of b, in one scan; null values as 'unknown'."""
    d = df.select(F.coalesce(F.col(a), F.lit("unknown")).alias(a), F.coalesce(F.col(b), F.lit("unknown")).alias(b), score)
    out = d.groupingSets([[], [F.col(a)], [F.col(b)]], F.col(a), F.col(b)).agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("best"), F.grouping_id().alias("g"))
    return out.select(F.when(F.col("g") == 3, "all").when(F.col("g") == 1, a).otherwise(b).alias("level"), F.coalesce(F.col(a), F.col(b)).alias("value"), "n", "best")


def group_multi(df: DataFrame, items: Column, missing: str, name: str = "key") -> DataFrame:
    """Rows under each value of a list column; rows of an empty or null list under the `missing` label."""
    return df.withColumn(name, F.explode_outer(items)).withColumn(name, F.coalesce(F.col(name), F.lit(missing)))


def string_inventory(df: DataFrame, strings: str, owner: Sequence[str], longest: int = 500) -> DataFrame:
    """(string, refs, owners): trimmed strings with their uses; blank ones and those over the length, untrimmed, are left out."""
    e = df.select(*owner, F.explode(strings).alias("raw")).where((F.length("raw") <= longest) & (F.trim("raw") != ""))
    return e.groupBy(F.trim("raw").alias("string")).agg(F.count(F.lit(1)).alias("refs"), F.count_distinct(F.struct(*owner)).alias("owners"))


def bucketed(c: Column, edges: Sequence[int], labels: Sequence[str]) -> Column:
    """Half-open buckets: labels[i] below edges[i], the last label from the last edge on."""
    out = F.when(c < edges[0], labels[0])
    for e, label in zip(edges[1:], labels[1:]):
        out = out.when(c < e, label)
    return out.otherwise(labels[len(edges)])


def cube_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    return df.cube(*dims).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))


def rollup_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    return df.rollup(*dims).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))


def run_status(total: Column, errors: Column, oks: Column, open_: Column) -> Column:
    """The state of a run from counts of its steps."""
    return F.when(total == 0, "empty").when(errors > 0, "error").when(oks == total, "ok").when(open_ > 0, "in_progress").otherwise("partial")


# ---------------------------------------------------------------- joins


def full_compare(a: DataFrame, b: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, left, right, verdict) of two tables with one row per key: only_left, only_right, same, differs."""
    x = a.select(*key, F.col(value).alias("left"), F.lit(True).alias("__l"))
    y = b.select(*key, F.col(value).alias("right"), F.lit(True).alias("__r"))
    verdict = F.when(F.col("__r").isNull(), "only_left").when(F.col("__l").isNull(), "only_right").when(F.col("left").eqNullSafe(F.col("right")), "same").otherwise("differs")
    return x.join(y, list(key), "full_outer").select(*key, "left", "right", verdict.alias("verdict"))


def field_compare(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, verdict) for each field: ok, missing (one side null), differs (trimmed texts unequal)."""
    long = lambda d, n: d.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(n)) for f in fields])).alias("x")).select(key, "x.field", f"x.{n}")
    j = long(a, "l").join(long(b, "r"), [key, "field"], "full_outer")
    v = F.when(F.col("l").isNull() & F.col("r").isNull(), "ok").when(F.col("l").isNull() | F.col("r").isNull(), "missing").when(F.trim("l") == F.trim("r"), "ok").otherwise("differs")
    return j.select(key, "field", v.alias("verdict"))


def interval_assignment(owners: DataFrame, items: DataFrame, within: str, order: str, size: str, position: str) -> DataFrame:
    """Ordered items cut into consecutive ranges, one per owner, by the owners' sizes; items beyond all ranges are left out.

    One sorted pass per group over owners' starts and items, instead of a join on a range.
    """
    o_cols, i_cols = [c for c in owners.columns if c != within], [c for c in items.columns if c != within]
    hi = F.sum(size).over(W.partitionBy(within).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    o = owners.where(F.col(size) > 0).withColumn("__hi", hi)
    o = o.select(F.col(within), (F.col("__hi") - F.col(size)).cast("bigint").alias("__at"), F.lit(0).alias("__kind"), F.struct("__hi", *o_cols).alias("__o"))
    i = items.select(F.col(within), F.col(position).cast("bigint").alias("__at"), F.lit(1).alias("__kind"), F.struct(*i_cols).alias("__i"))
    line = W.partitionBy(within).orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0)
    both = o.unionByName(i, allowMissingColumns=True).withColumn("__o", F.last("__o", ignorenulls=True).over(line))
    found = both.where((F.col("__kind") == 1) & (F.col("__at") < F.col("__o.__hi")))
    return found.select(within, *[F.col(f"__o.{c}").alias(c) for c in o_cols], *[F.col(f"__i.{c}").alias(c) for c in i_cols if c not in o_cols])


def siblings(df: DataFrame, targets: DataFrame, key: str, parents: Sequence[str]) -> DataFrame:
    """(key, sibling): rows that share any parent value with a target (column `key`), each pair once, none with itself."""
    pairs = []
    for p in parents:
        all_ = df.select(F.col(key).alias("sibling"), F.col(p).alias("__p")).where(F.col(p).isNotNull()).distinct()
        mine = df.join(targets.select(key).distinct(), key, "left_semi").select(key, F.col(p).alias("__p")).distinct()
        pairs.append(mine.join(all_, "__p").where(F.col(key) != F.col("sibling")).select(key, "sibling"))
    return reduce(DataFrame.union, pairs).distinct()


def with_fallback(primary: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the first table, and rows of the other one for keys that the first lacks."""
    return primary.unionByName(other.join(primary.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def version_diff(old: DataFrame, new: DataFrame, key: Sequence[str], lists: str) -> DataFrame:
    """(key, change, gained, lost): added, removed or common keys, and what a list column gained and lost."""
    x = old.select(*key, F.col(lists).alias("__o"), F.lit(1).alias("__x"))
    y = new.select(*key, F.col(lists).alias("__n"), F.lit(1).alias("__y"))
    j = x.join(y, list(key), "full_outer")
    none = F.array().cast("array<string>")
    o, n = F.coalesce("__o", none), F.coalesce("__n", none)
    change = F.when(F.col("__x").isNull(), "added").when(F.col("__y").isNull(), "removed").otherwise("common")
    return j.select(*key, change.alias("change"), F.array_join(F.array_sort(F.array_except(n, o)), ",").alias("gained"), F.array_join(F.array_sort(F.array_except(o, n)), ",").alias("lost"))


# ---------------------------------------------------------------- evidence on fields


def merge_fields(df: DataFrame, keys: Sequence[str], size: str, kind: str, verified: str) -> DataFrame:
    """One row per key: a verified size counts before an unverified one, then the largest; kinds joined; verified if any is."""
    return df.groupBy(*keys).agg(
        F.max_by(F.col(size), F.struct(F.col(verified), F.col(size))).alias(size),
        F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"),
        F.bool_or(verified).alias(verified),
        F.count(F.lit(1)).alias("n"),
    )


def with_gaps(fields: DataFrame, within: str, offset: str, size: str) -> DataFrame:
    """(within, offset, size, is_gap): fields and a row for each gap before one, measured from the furthest end so far."""
    end = F.coalesce(F.max(F.col(offset) + F.col(size)).over(W.partitionBy(within).orderBy(offset).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    f = fields.select(within, F.col(offset).cast("double").alias(offset), F.col(size).cast("double").alias(size)).withColumn("__end", end.cast("double"))
    gaps = f.where(F.col(offset) > F.col("__end")).select(within, F.col("__end").alias(offset), (F.col(offset) - F.col("__end")).alias(size), F.lit(True).alias("is_gap"))
    return f.select(within, offset, size, F.lit(False).alias("is_gap")).unionByName(gaps)
