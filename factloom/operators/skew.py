"""Joins and grouping that stay balanced when a few keys hold most rows."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.columns import fresh, own_prefix
from factloom.session import cut

#: Rows and bytes up to which the right side of lookup_join is broadcast; beyond either, the sharded join is used.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16_000_000


def _murmur_int(values: np.ndarray, seed: int) -> np.ndarray:
    """Murmur3 (32 bit) of ints, as Spark's hash partitioning continues it from the hash of earlier columns."""
    with np.errstate(over="ignore"):
        k = values.astype(np.uint32) * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(seed & 0xFFFFFFFF) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    return h.view(np.int32)


def salt_for(seed: int, task: int, tasks: int, tried: int = 1) -> int:
    """The least salt >= 1 for which a key with this hash lands in the given shuffle partition."""
    start = tried
    while True:
        s = np.arange(start, start + 4 * tasks, dtype=np.int64)
        hit = np.nonzero(_murmur_int(s, seed).astype(np.int64) % tasks == task)[0]
        if len(hit):
            return int(s[hit[0]])
        start += 4 * tasks


def pack(heavy: Sequence[tuple[float, int]], light: Sequence[float], tasks: int) -> list[list[int]]:
    """Tasks for the shards of each heavy key.

    heavy: load and number of shards per key; light: load that each task already has.
    Largest shards go first, each to the least loaded task that has no shard of the same key yet.
    """
    heap = [(load, t) for t, load in enumerate(light)]
    heapq.heapify(heap)
    placed: list[list[int]] = [[] for _ in heavy]
    for i in sorted(range(len(heavy)), key=lambda i: -heavy[i][0] / heavy[i][1]):
        load, shards = heavy[i]
        taken = [heapq.heappop(heap) for _ in range(min(shards, tasks))]
        for have, t in taken:
            placed[i].append(t)
            heapq.heappush(heap, (have + load / shards, t))
    return placed


def _eq(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for x, y in pairs:
        cond = cond & (a[x] == b[y])
    return cond


def shard_table(left: DataFrame, keys: Sequence[str], tasks: int | None = None, loads: DataFrame | None = None, mark: str | None = None) -> tuple[DataFrame, list[str], str]:
    """Heavy keys of a table with the salts of their shards: (table, its key columns, its array column).

    A key is heavy if it holds over half of a task's even share of rows, so there are fewer than
    2 * tasks heavy keys whatever the input; only those, and one load per task, reach the driver.
    loads: rows per key, if already known (key columns and a column 'load'; read twice, so give a cut table).  mark: begins the table's names.
    """
    spark = left.sparkSession
    mark = mark or own_prefix(left)
    load, seed, salts = f"{mark}load", f"{mark}seed", f"{mark}salts"
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = [f"{mark}h{i}" for i in range(len(keys))]
    named = [F.col(c).alias(n) for c, n in zip(keys, k)]
    if loads is not None:
        known = loads.select(*named, F.col("load").cast("double").alias(load))
    else:
        known = left.where(_all_there(keys)).select(*named).groupBy(*k).agg(F.count(F.lit(1)).cast("double").alias(load))
    known = (cut(known) if loads is None else known).withColumn(seed, F.hash(*k))
    per_task = {r[0]: (r[1], r[2]) for r in known.groupBy(F.pmod(F.hash(*k, F.lit(0)), F.lit(tasks))).agg(F.sum(load), F.count(F.lit(1))).collect()}
    total = sum(x for x, _ in per_task.values())
    share = total / tasks
    rows = known.where(F.col(load) > share / 2).collect() if tasks > 1 and total else []
    light = [per_task.get(t, (0.0, 0))[0] for t in range(tasks)]
    for r in rows:  # a heavy key's rows leave the place where its hash had put them
        light[int(_murmur_int(np.array([0]), r[seed])[0]) % tasks] -= r[load]
    plan = [(r[load], min(tasks, max(1, -(-int(r[load]) // max(1, int(share)))))) for r in rows]
    bins = pack(plan, light, tasks)
    schema = known.select(*k).schema.add(salts, T.ArrayType(T.IntegerType()))
    data = [(*[r[c] for c in k], [salt_for(r[seed], t, tasks) for t in b]) for r, b in zip(rows, bins)]
    return spark.createDataFrame(data, schema), k, salts


def _all_there(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).isNotNull()
    return cond


def fragment_replicate_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    tasks: int | None = None,
    loads: DataFrame | None = None,
    keep_shard: str | None = None,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Equi-join on columns of the same names, balanced under any skew of the left side.

    Keys get tasks by their load on the left: large keys are split into shards in proportion to
    their rows, shards are bin-packed to tasks, and right rows go only to the shards of their key.
    how: inner, left, left_semi or left_anti.  Keys that are null match nothing (left and left_anti keep
    those rows, spread over all tasks).  The result has the left columns, then the right ones without the
    keys; a right column whose name the left side has gets the suffix _right.  keep_shard: name of a
    column that holds the shard, so that a later groupBy(keys, shard) needs no further shuffle.
    Repeated rows stay repeated; an empty side gives what the plain join gives.  Rows are dealt to the
    shards of their key by a hash of the columns spread_by, which should differ between rows, else of all
    columns and the row's number, so shards are even although rows are equal in every column.  The number is
    the same in a task that runs again if the left side is scanned or cut; give spread_by where it isn't.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mark = own_prefix(left, right)
    salts, hk, arr = shard_table(left, keys, tasks, loads, mark)
    salt = fresh(keep_shard or f"{mark}shard", left, right)
    heavy = F.broadcast(salts)  # fewer than 2 * tasks rows
    place, left_cols = f"{mark}place", left.columns
    left = left.withColumn(place, F.xxhash64(*([F.col(c) for c in spread_by] or [*[left[c] for c in left_cols], F.monotonically_increasing_id()])))
    spread = F.pmod(F.col(place), F.size(arr).cast("bigint"))
    lost = F.lit(False)
    for c in keys:
        lost = lost | left[c].isNull()
    mine = F.when(F.col(arr).isNotNull(), F.element_at(arr, (spread + 1).cast("int"))).when(lost, F.pmod(F.col(place), F.lit(4 * tasks)).cast("int")).otherwise(0)
    l2 = left.join(heavy, _eq(left, salts, list(zip(keys, hk))), "left").select(*[left[c] for c in left_cols], mine.alias(salt))
    taken = {c.lower() for c in left_cols}
    names = {c: (fresh(f"{c}_right", left, right) if c.lower() in taken else c) for c in right.columns if c not in keys}
    r1 = right.select(*[F.col(c).alias(f"{mark}r{i}") for i, c in enumerate(keys)], *[F.col(c).alias(n) for c, n in names.items()])
    rk = [f"{mark}r{i}" for i in range(len(keys))]
    r2 = r1.join(heavy, _eq(r1, salts, list(zip(rk, hk))), "left").select(*rk, *names.values(), F.explode(F.coalesce(F.col(arr), F.array(F.lit(0)))).alias(f"{mark}rs"))
    cond = F.lit(True)
    for c, n in zip(keys, rk):
        cond = cond & (F.col(c) == F.col(n))
    cond = cond & (F.col(salt) == F.col(f"{mark}rs"))  # last: salt_for counts on this order of the shuffle's hash
    out = l2.join(r2, cond, how)
    if how in ("left_semi", "left_anti"):
        return out.drop(salt) if not keep_shard else out
    return out.select(*left_cols, *names.values(), *([salt] if keep_shard else []))


def _width(df: DataFrame) -> Column:
    """The bytes of a row's values, roughly: texts by length, nested values as JSON, others 8."""
    total = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total = total + 8
    return total


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table was counted to have no more rows and bytes than given."""
    r = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df).cast("bigint")), F.lit(0))).first()
    return r[0] <= rows and r[1] <= most_bytes


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = BROADCAST_ROWS, spread_by: Sequence[str] = (), small: bool | None = None) -> DataFrame:
    """Join with a side that is often small: broadcast if its rows and bytes were counted to be few, else fragment_replicate_join.

    small: what is_small() said of a table that has at least as many rows and bytes, so that they aren't counted again.
    """
    if not (is_small(right, limit) if small is None else small):
        return fragment_replicate_join(left, right, keys, how, spread_by=spread_by)
    mark = own_prefix(left, right)
    taken = {c.lower() for c in left.columns}
    names = {c: (fresh(f"{c}_right", left, right) if c.lower() in taken else c) for c in right.columns if c not in keys}
    rk = [f"{mark}r{i}" for i in range(len(keys))]
    r = right.select(*[F.col(c).alias(k) for c, k in zip(keys, rk)], *[F.col(c).alias(x) for c, x in names.items()])
    cond = F.lit(True)
    for c, k in zip(keys, rk):
        cond = cond & (F.col(c) == F.col(k))
    out = left.join(F.broadcast(r), cond, how)
    return out if how in ("left_semi", "left_anti") else out.select(*left.columns, *names.values())


def grouped_by_shard(joined: DataFrame, keys: Sequence[str], shard: str, partial: dict[str, Column], merge: dict[str, Column]) -> DataFrame:
    """Per-key results from per-shard ones: first by (keys, shard), where the rows already lie, then by keys."""
    first = joined.groupBy(*keys, shard).agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])
