from __future__ import annotations

import math
import random

import pytest

from factloom.llm import cutoff
from factloom.llm.cutoff import cutoffs


def brute(rows, targets):
    out = {}
    for g, f in targets.items():
        s = [x for k, x in rows if k == g and x is not None and not math.isnan(x)]
        if s and f is not None:
            f = min(1.0, max(0.0, f))
            c = max(c for c in s if sum(x >= c for x in s) >= max(1, math.ceil(round(f * len(s), 9))))
            out[g] = (c, sum(x >= c for x in s), len(s))
    return out


@pytest.mark.parametrize("limit", [200_000, 20])
def test_matches_brute_force(spark, monkeypatch, limit):
    """With the small limit the bracket is narrowed several times."""
    monkeypatch.setattr(cutoff, "SORTED_VALUES", limit)
    r = random.Random(1)
    rows = [("a", r.random()) for _ in range(4000)] + [("b", float(r.randrange(5))) for _ in range(1000)] + [("c", 1.0)] * 300 + [("d", None), ("d", float("nan")), ("e", 2.0), (None, 1.0), ("z", 1.0)]
    targets = {"a": 0.3, "b": 0.25, "c": 0.5, "d": 0.5, "e": 0.0, "f": 0.5, "g": None}
    df = spark.createDataFrame([(g, s, i) for i, (g, s) in enumerate(rows)], "g string, s double, above int")
    t = spark.createDataFrame(list(targets.items()), "name string, f double")
    got = {x["g"]: (x["cutoff"], x["kept"], x["scored"]) for x in cutoffs(df, "g", "s", t, "name", "f").collect()}
    assert got == brute(rows, targets)


def test_all_and_none(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)], "g string, s double")
    t = lambda f: spark.createDataFrame([("a", f)], "g string, f double")
    one = lambda f: cutoffs(df, "g", "s", t(f), "g", "f").first()
    assert one(1.0)["cutoff"] == 0 and one(5.0)["kept"] == 10 and one(0.0)["cutoff"] == 9 and one(0.2)["cutoff"] == 8
    assert cutoffs(df.limit(0), "g", "s", t(0.5), "g", "f").count() == 0
