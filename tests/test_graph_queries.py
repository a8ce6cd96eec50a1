"""Graph queries beside brute force on a small table of order lines, none of which is singled out."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest

from factloom.plans.graphs import QUERIES

CHAINS = [[1, 2, 3, 4, 2], [4, 5], [1, 6, 7, 8, 9, 10, 11], [1, 12], [7, 6], [20, 20, 21], [1, 2]]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """(folder, edges): orders as chains of parts, lines shuffled, of every flag and quantity."""
    d, rnd = str(tmp_path_factory.mktemp("lines")), random.Random(3)
    lines = [(o, n, p, 1, "ANR"[(o + n) % 3], float(1 + (7 * o + 11 * n) % 50)) for o, c in enumerate(CHAINS) for n, p in enumerate(c)]
    rnd.shuffle(lines)
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    parts = [(i, f"part {i}", f"brand {i % 3}", 30 + i) for i in range(1, 23)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_size int").write.parquet(f"{d}/part.parquet")
    return d, {e for c in CHAINS for e in itertools.pairwise(c) if e[0] != e[1]}


def walk(edges, start, most=None):
    """node -> least number of steps."""
    depth, front = {start: 0}, [start]
    for k in itertools.count(1):
        if most is not None and k > most:
            return depth
        front = sorted({b for a, b in edges if a in front} - set(depth))
        if not front:
            return depth
        depth.update(dict.fromkeys(front, k))


def rows(spark, made, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, made[0]).collect())


def test_reach(spark, made):
    e = made[1]
    assert rows(spark, made, "bfs_depth") == sorted(walk(e, 1, 6).items())
    assert rows(spark, made, "callers_depth") == sorted(walk({(b, a) for a, b in e}, 1, 4).items())
    assert rows(spark, made, "deepest_reach") == [(max(walk(e, 1, 6).values()), len(walk(e, 1, 6)))]
    assert rows(spark, made, "shortest_path_len") == [(max(walk(e, 1, 8).values()) + 1,)]
    near = set(walk(e, 1, 2))
    assert sorted((r["src"], r["dst"]) for r in QUERIES["reach_subgraph"](spark, made[0]).collect()) == sorted((a, b) for a, b in e if a in near and b in near)


def test_many_entries(spark, made):
    e = made[1]
    out = defaultdict(int)
    for a, _ in e:
        out[a] += 1
    found = {s: walk(e, s, 4) for s in sorted(out, key=lambda a: (-out[a], a))[:5]}
    hist, near = defaultdict(int), {}
    for s, w in found.items():
        for node, k in w.items():
            hist[k] += 1
            near[node] = min(near.get(node, (99, 0)), (k, s))
    assert rows(spark, made, "multi_source_depth_hist") == sorted(hist.items())
    assert sorted((r["node"], r["source"], r["steps"]) for r in QUERIES["nearest_entry"](spark, made[0]).collect()) == sorted((n, s, k) for n, (k, s) in near.items())
    marks = {s: [n for n in w if 30 + n >= 40] for s, w in found.items()}
    assert rows(spark, made, "danger_reach") == sorted((s, len(m), len({n % 3 for n in m}), min(found[s][n] for n in m)) for s, m in marks.items() if m)


def test_components_and_levels(spark, made):
    e = made[1]
    nodes = {n for x in e for n in x}
    after = {n: set(walk(e, n)) for n in nodes}
    loops = {n: [m for m in after[n] if n in after[m]] for n in nodes}
    assert rows(spark, made, "scc_groups") == sorted((n, max(g)) for n, g in loops.items() if len(g) > 1)
    cyclic = {n for n in nodes if any(len(loops[m]) > 1 for m in after[n])}

    def level(n):
        return -1 if n in cyclic else max((1 + level(b) for a, b in e if a == n), default=0)

    assert rows(spark, made, "topo_levels") == sorted((n, level(n)) for n in nodes)


def test_measures(spark, made):
    e = made[1]
    src, dst, parts = {a for a, _ in e}, {b for _, b in e}, set(range(1, 23))
    deg = {n: (sum(b == n for _, b in e), sum(a == n for a, _ in e)) for n in src | dst}
    best = sorted(deg, key=lambda n: (-sum(deg[n]), n))[:20]
    assert [r["node"] for r in QUERIES["hub_rank"](spark, made[0]).orderBy("rank").collect()] == best
    assert rows(spark, made, "graph_stats") == [(len(parts), len(e), len(parts), len(e) / (22 * 21))]
    assert rows(spark, made, "leaf_root_nodes") == sorted([("leaf", n) for n in dst - src] + [("root", n) for n in src - dst])
    assert {r[0] for r in rows(spark, made, "entry_nodes")} == parts - dst
    assert {r[0] for r in rows(spark, made, "dead_nodes_anti")} == parts - src - dst
    assert rows(spark, made, "bottlenecks") == sorted((n, i, o, i * o) for n, (i, o) in deg.items() if i >= 3 and o >= 3)
    assert rows(spark, made, "neighbours") == sorted([("out", b) for a, b in e if a == 1] + [("in", a) for a, b in e if b == 1])


def test_paths_and_chains(spark, made):
    e = made[1]
    target = min(b for a, b in e if a == 1)
    paths, front = [], [(1,)]
    for _ in range(3):
        front = [(*p, b) for p in front for a, b in e if a == p[-1] and b not in p]
        paths += [p for p in front if p[-1] == target]
    assert sorted(r[0] for r in rows(spark, made, "simple_paths")) == sorted(">".join(map(str, p)) for p in paths)
    nxt = {a: min(b for x, b in e if x == a) for a, _ in e}
    want = []
    for s in nxt:
        path = [s]
        while len(path) < 6 and nxt.get(path[-1], s) not in path:
            path.append(nxt[path[-1]])
        want += [(s, i, n) for i, n in enumerate(path)]
    assert rows(spark, made, "forwarder_chain") == sorted(want)
