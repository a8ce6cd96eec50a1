from __future__ import annotations

import random

from pyspark.sql import functions as F

from factloom.llm.topn import survivors, thresholds, top_n


def test_matches_sorting(spark):
    r = random.Random(2)
    rows = [("hot", round(r.random(), 2), i) for i in range(5000)] + [(f"g{r.randrange(200)}", round(r.random(), 1), 5000 + i) for i in range(3000)]
    rows += [("tie", 0.5, 9000 + i) for i in range(50)] + [("none", None, 1), ("nan", float("nan"), 2), (None, 1.0, 3), ("hot", 1.0, 10_000), ("hot", 1.0, 10_000)]
    df = spark.createDataFrame(rows, "g string, s double, place int")
    got = sorted((x["g"], x["place_1"], x["s"], x["place"]) for x in top_n(df, ["g"], "s", [F.col("place")], 3).collect())
    want = []
    for g in {g for g, s, _ in rows if g is not None}:
        best = sorted((-s, i) for k, s, i in rows if k == g and s is not None and s == s)[:3]
        want += [(g, p, -s, i) for p, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert top_n(df.limit(0), ["g"], "s", [F.col("place")], 3).count() == 0


def test_threshold_is_safe(spark):
    df = spark.createDataFrame([("a", i % 7) for i in range(100)] + [("b", 3)], "g string, b int")
    t = {r["g"]: (r["least"], r["load"]) for r in thresholds(df, ["g"], "b", 20).collect()}
    assert t == {"a": (5, 100), "b": (3, 1)}
    assert survivors(df, ["g"], "b", 20).groupBy("g").count().collect() == [("a", 28), ("b", 1)] or {r["g"]: r["count"] for r in survivors(df, ["g"], "b", 20).groupBy("g").count().collect()} == {"a": 28, "b": 1}
