from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph as G


@pytest.fixture(scope="module")
def edges(spark):
    def make(*pairs):
        return spark.createDataFrame(list(pairs), "src string, dst string")

    return make


def starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entry string")


def depths(df):
    return {r["node"]: r["depth"] for r in df.collect()}


def test_chain(spark, edges):
    e = edges(("A", "B"), ("B", "C"))
    assert depths(G.reach(e, starts(spark, "A"))) == {"A": 0, "B": 1, "C": 2}
    assert depths(G.reach(e, starts(spark, "A"), 1)) == {"A": 0, "B": 1}
    assert depths(G.callers(e, starts(spark, "C"))) == {"C": 0, "B": 1, "A": 2}
    assert [r["node"] for r in G.shortest_path(e, "A", "C").orderBy("pos").collect()] == ["A", "B", "C"]
    assert G.shortest_path(e, "C", "A").count() == 0
    assert [r["node"] for r in G.shortest_path(e, "A", "A").collect()] == ["A"]
    assert [r[0] for r in G.roots(e).collect()] == ["A"] and [r[0] for r in G.leaves(e).collect()] == ["C"]
    assert {r["node"]: r["level"] for r in G.levels(e).collect()} == {"C": 0, "B": 1, "A": 2}


def test_diamond(spark, edges):
    e = edges(("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("A", "B"))
    assert [r["path"] for r in G.simple_paths(e, "A", "D", 3).collect()] == [["A", "B", "D"], ["A", "C", "D"]]
    assert G.simple_paths(e, "A", "D", 2).count() == 0 and G.simple_paths(e, "A", "D", 5, most=1).count() == 1
    assert depths(G.reach(e, starts(spark, "A")))["D"] == 2
    assert [r["node"] for r in G.shortest_path(e, "A", "D").orderBy("pos").collect()] == ["A", "B", "D"]
    hist = {r["depth"]: r["n"] for r in G.depth_histogram(G.reach(e, starts(spark, "A", "B"))).collect()}
    assert hist == {0: 2, 1: 3, 2: 1}
    near = {r["node"]: (r["source"], r["steps"]) for r in G.nearest_source(e, starts(spark, "A", "B"), 5).collect()}
    assert near["D"] == ("B", 1) and near["C"] == ("A", 1)


def test_cycle(spark, edges):
    e = edges(("A", "B"), ("B", "C"), ("C", "A"), ("X", "X"), ("C", "T"), ("R", "A"), ("U", "V"), ("V", "U"))
    got = {}
    for r in G.components(e).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [["A", "B", "C"], ["U", "V"]]
    ring = edges(("A", "B"), ("B", "C"), ("C", "A"))
    assert G.roots(ring).count() == 0 and G.leaves(ring).count() == 0
    lv = {r["node"]: r["level"] for r in G.levels(e).collect()}
    assert lv["T"] == 0 and lv["A"] == -1 and lv["R"] == -1
    assert G.components(edges(("A", "B"), ("B", "C"))).count() == 0


def test_components_against_brute_force(spark, edges):
    import random

    r = random.Random(7)
    pairs = [(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(70)]
    nodes = {x for p in pairs for x in p}
    out = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            out[a] |= out[b]
    want = sorted({tuple(sorted(m for m in nodes if m in out[n] and n in out[m])) for n in nodes})
    got = {}
    for x in G.components(edges(*pairs)).collect():
        got.setdefault(x["component"], set()).add(x["node"])
    assert sorted(tuple(sorted(v)) for v in got.values()) == [c for c in want if len(c) > 1]


def test_internal_depth(spark, edges):
    e, d = edges(("A", "B"), ("B", "X"), ("X", "C")), spark.createDataFrame([("A",), ("B",), ("C",)], "node string")
    assert depths(G.reach_internal(e, d, starts(spark, "A"), 0)) == {"A": 0}
    assert depths(G.reach_internal(e, d, starts(spark, "A"))) == {"A": 0, "B": 1}
    assert {r[0] for r in G.entries(e, d).collect()} == {"A", "C"}
    s = G.graph_stats(e, d).first()
    assert (s["nodes"], s["edges"], s["defined"], s["density"]) == (4, 3, 3, 0.5)


def test_edges_of_functions(spark):
    x = "array<struct<function_name:string,name:string,function_id:bigint,module_name:string,function_type:int>>"
    rows = [
        ("m", "A", [("B", None, 2, "", 0), ("Api", None, None, "k32.dll", 3), ("g", None, None, "data", 4), ("vt", None, 9, "vtable", 8)], []),
        ("m", "B", [], [("A", None, 1, "", 0), (None, "Z", 7, "", 0)]),
    ]
    f = spark.createDataFrame(rows, f"module string, function_name string, outbound {x}, inbound {x}")
    e = {(r["src"], r["dst"]) for r in G.call_edges(f).collect()}
    assert e == {("A", "B"), ("A", "Api"), ("A", "vt"), ("Z", "B")}
    assert ("A", "vt") not in {(r["src"], r["dst"]) for r in G.call_edges(f, include_vtable=False).collect()}
    assert [(r["dst"], r["dst_module"]) for r in G.external(G.call_edges(f)).collect()] == [("Api", "k32.dll")]
    mods = spark.createDataFrame([("m",), ("k32.dll",)], "module string")
    assert [tuple(r) for r in G.module_edges(G.call_edges(f), mods).collect()] == [("m", "k32.dll")]


def test_chain_of_forwards(spark, edges):
    e = edges(("a", "b"), ("b", "c"), ("c", "a"), ("p", "q"), ("p", "r"))
    s = spark.createDataFrame([("a",), ("p",), ("z",)], "start string")
    got = {}
    for r in G.follow_chain(e, s).orderBy("start", "hop").collect():
        got.setdefault(r["start"], []).append(r["node"])
    assert got == {"a": ["a", "b", "c"], "p": ["p", "q"], "z": ["z"]}


def test_measures(spark, edges):
    e = edges(*[(f"i{k}", "hub") for k in range(3)], *[("hub", f"o{k}") for k in range(4)])
    assert [tuple(r) for r in G.bottlenecks(e).collect()] == [("hub", 3, 4, 12)]
    assert {(r["direction"], r["node"]) for r in G.neighbours(e, "o1").collect()} == {("in", "hub")}
    marks = spark.createDataFrame([("o1", "x"), ("o2", "x"), ("hub", "y")], "node string, api string")
    r = G.danger_reach(G.reach(e, starts(spark, "i0")), marks).first()
    assert (r["refs"], r["apis"], r["first_depth"]) == (3, 2, 1)
    assert G.subgraph(e, spark.createDataFrame([("i0",), ("hub",)], "node string")).count() == 1
    u = G.unified_edges([("call", e.limit(1)), ("ipc", edges(("q", "r")))])
    assert {r["edge_type"] for r in u.collect()} == {"call", "ipc"}
    t = G.trust_transitions(spark.createDataFrame([("a", "b"), ("b", "a")], "module string, dst_module string"), spark.createDataFrame([("a", 1), ("b", 2)], "module string, rank int"))
    assert {r["transition"] for r in t.collect()} == {"escalation", "drop"}


def test_allowed_edges(spark, edges):
    e = edges(("A", "B"), ("B", "C"))
    assert depths(G.reach(e, starts(spark, "A"), allowed=F.col("dst") != "C")) == {"A": 0, "B": 1}
