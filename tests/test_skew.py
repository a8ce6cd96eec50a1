from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators.skew import _murmur_int, fragment_replicate_join, grouped_by_shard, is_small, lookup_join, pack, salt_for


@pytest.fixture(scope="module")
def skewed(spark):
    r = random.Random(3)
    rows = [("hot", 1, i) for i in range(3000)] + [(f"k{r.randrange(300)}", r.randrange(3), i) for i in range(3000)]
    rows += [(None, 1, -i) for i in range(500)] + [("k1", None, -2)] * 20 + [("hot", 1, 7)] * 100  # lost keys and repeated rows
    right = [("hot", 1, "h"), ("hot", 1, "h2")] + [(f"k{i}", i % 3, f"v{i}") for i in range(0, 300, 2)] + [(None, 1, "n")]
    left = spark.createDataFrame(rows, "a string, b int, v int")
    return left, spark.createDataFrame(right, "a string, b int, v string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_plain_join(skewed, how):
    left, right = skewed
    got = fragment_replicate_join(left, right, ["a", "b"], how, tasks=8)
    want = left.join(right.withColumnRenamed("v", "v_right"), ["a", "b"], how).select(*got.columns)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))


def test_no_task_gets_the_hot_key(spark, skewed):
    left, right = skewed
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = right.dropDuplicates(["a", "b"])
        sizes = [r["count"] for r in fragment_replicate_join(left, one, ["a", "b"], "left").groupBy(F.spark_partition_id()).count().collect()]
        plain = [r["count"] for r in left.join(one, ["a", "b"], "left").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    share = left.count() / 8
    assert len(sizes) == 8 and max(sizes) < 1.5 * share < max(plain)


def test_empty_sides(spark, skewed):
    left, right = skewed
    assert fragment_replicate_join(left.limit(0), right, ["a", "b"]).count() == 0
    assert fragment_replicate_join(left, right.limit(0), ["a", "b"], "left").count() == left.count()


def test_salts_hit_their_task(spark):
    import numpy as np

    seeds = [r[0] for r in spark.range(50).select(F.hash(F.col("id").cast("string"))).collect()]
    for s in seeds:
        for t in (0, 3, 6):
            salt = salt_for(s, t, 7)
            assert int(_murmur_int(np.array([salt]), s)[0]) % 7 == t
    df = spark.range(50).select(F.col("id").cast("string").alias("k"))
    got = df.select(F.pmod(F.hash("k", F.lit(5)), F.lit(7)).alias("p"), F.hash("k").alias("h")).collect()
    assert all(r["p"] == int(_murmur_int(np.array([5]), r["h"])[0]) % 7 for r in got)


def test_pack_spreads_shards():
    placed = pack([(100.0, 4), (30.0, 1)], [0.0, 10.0, 10.0, 10.0, 50.0], 5)
    assert len(set(placed[0])) == 4 and 4 not in placed[1]


def test_grouped_by_shard(skewed):
    left, right = skewed
    one = right.dropDuplicates(["a", "b"]).drop("v")
    j = fragment_replicate_join(left, one, ["a", "b"], keep_shard="s", tasks=8)
    got = {(r["a"], r["b"]): r["n"] for r in grouped_by_shard(j, ["a", "b"], "s", {"n": F.count(F.lit(1))}, {"n": F.sum("n")}).collect()}
    want = {(r["a"], r["b"]): r["count"] for r in left.join(one, ["a", "b"]).groupBy("a", "b").count().collect()}
    assert got == want and got["hot", 1] == 3100


def test_lookup_join_both_ways(skewed):
    left, right = skewed
    a = lookup_join(left, right, ["a", "b"], "left", limit=10_000).collect()
    b = lookup_join(left, right, ["a", "b"], "left", limit=5).collect()
    assert collections.Counter(map(tuple, a)) == collections.Counter(map(tuple, b))


def test_clashing_names(spark):
    left = spark.createDataFrame([("x", 1, 2, 3)], "k string, __shard int, __salts int, load int")
    right = spark.createDataFrame([("x", 9)], "k string, __shard int")
    assert fragment_replicate_join(left, right, ["k"]).columns == ["k", "__shard", "__salts", "load", "__shard_right"]


def test_small_by_rows_and_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2], 1), (None, None, None)], "t string, a array<int>, n int")
    assert is_small(df, 2, 2000) and not is_small(df, 1, 2000) and not is_small(df, 2, 900) and is_small(df.limit(0), 0, 0)


def test_shards_are_even_although_rows_are_equal(spark):
    left = spark.createDataFrame([("hot",)] * 8000 + [(f"k{i}",) for i in range(2000)], "k string").repartition(2).sortWithinPartitions("k")
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    got = fragment_replicate_join(left, right, ["k"], tasks=20, keep_shard="s").groupBy("s").count().collect()
    planned = 8000 / len(got)
    assert len(got) >= 15 and max(r["count"] for r in got) < 1.3 * planned


def test_hot_pairs_are_split_as_planned(spark, tmp_path):
    from factloom.plans.problems import hot_pairs
    from tests.fixture_tables import FUNCTION_ROWS, finding, folder

    f = [finding(i, name="Open") for i in range(900)] + [finding(1000 + i, name="Run", module=None if i % 2 else "a.dll") for i in range(6)]
    d = folder(spark, tmp_path, findings=f, module_functions=FUNCTION_ROWS)
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    assert [tuple(r) for r in hot_pairs(read("findings"), read("module_functions")).collect()] == [("a.dll", "Open")]
    assert hot_pairs(read("findings").limit(0), read("module_functions")).count() == 0
