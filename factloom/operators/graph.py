"""Directed graphs as edge tables (src, dst): bounded reach, paths, components, orders and measures.

Iterative operators keep their state in DataFrames; each round's result is written to the shared
folder (session.cut), so plans stay short and a lost executor costs no restart.  Only row counts
reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.model import xref_name
from factloom.session import cut, placed

# The kinds of a referenced function that are no code.
DATA_TYPE, VTABLE_TYPE = 4, 8


def followable(x: Column, include_vtable: bool = True) -> Column:
    """Whether an edge leads to code: no data reference and, unless wanted, no virtual table."""
    module, kind = F.lower(F.coalesce(x["module_name"], F.lit(""))), F.coalesce(x["function_type"], F.lit(0))
    ok = (module != "data") & (kind != DATA_TYPE)
    return ok if include_vtable else ok & (module != "vtable") & (kind != VTABLE_TYPE)


def call_edges(functions: DataFrame, include_vtable: bool = True) -> DataFrame:
    """(module, src, dst, dst_id, dst_module) from both outbound and inbound lists of parsed functions, once each."""
    one = lambda col: functions.select("module", "function_name", F.explode(F.filter(col, lambda x: followable(x, include_vtable))).alias("x"))
    out = one("outbound").select("module", F.col("function_name").alias("src"), xref_name(F.col("x")).alias("dst"), F.col("x.function_id").alias("dst_id"), F.lower("x.module_name").alias("dst_module"))
    back = one("inbound").select("module", xref_name(F.col("x")).alias("src"), F.col("function_name").alias("dst"), F.lit(None).cast("bigint").alias("dst_id"), F.lit("").alias("dst_module"))
    return out.unionByName(back).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def external(edges: DataFrame) -> DataFrame:
    """Edges that leave the module: no target id, but a target module."""
    return edges.where(F.col("dst_id").isNull() & (F.coalesce(F.col("dst_module"), F.lit("")) != ""))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(edges: DataFrame, starts: DataFrame, max_depth: int = 0, allowed: Column | None = None) -> DataFrame:
    """(entry, node, depth) of all nodes within max_depth steps of each entry (0: no bound); entries at depth 0.

    starts: a column 'entry'.  allowed: a condition on edges (src, dst).  All entries are followed in one
    traversal, whose rounds are as many as the longest shortest path.
    """
    e = edges.select("src", "dst") if allowed is None else edges.where(allowed).select("src", "dst")
    out, heavy = _by_source(cut(e.where("src IS NOT NULL AND dst IS NOT NULL").distinct()))
    frontier = placed(starts.select("entry", F.col("entry").alias("node")).where("entry IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "entry", "node")
    seen, depth = frontier, 0
    while max_depth <= 0 or depth < max_depth:
        depth += 1
        asked = _ask(frontier.select("entry", "node"), heavy)
        nxt = asked.join(out, ["node", "part"]).select("entry", F.col("dst").alias("node")).distinct()
        # only the frontier and what it leads to are shuffled: edges and seen nodes lie where their keys put them
        frontier = placed(nxt.join(seen.select("entry", "node"), ["entry", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = placed(seen)
    return seen


def _by_source(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(out, heavy): edges (node, part, dst) placed by node and part, and the nodes of so many edges that they have several parts.

    heavy: (node, parts), at most as many rows as there are shuffle partitions.
    """
    spark = edges.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, -(-edges.count() // tasks))
    many = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share)
    rows = [(r["node"], -(-r["n"] // share)) for r in many.collect()]  # fewer than tasks, by pigeonhole
    heavy = spark.createDataFrame(rows, edges.select(F.col("src").alias("node")).schema.add("parts", "integer"))
    e = edges.select(F.col("src").alias("node"), "dst").join(F.broadcast(heavy), "node", "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("dst"), F.col("parts"))).otherwise(0).cast("int")
    return placed(e.select("node", part.alias("part"), "dst"), "node", "part"), heavy


def _ask(frontier: DataFrame, heavy: DataFrame) -> DataFrame:
    """The frontier once for each part of its nodes' edges."""
    f = frontier.join(F.broadcast(heavy), "node", "left")
    return f.select(*frontier.columns, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))


def reach_internal(edges: DataFrame, defined: DataFrame, starts: DataFrame, max_depth: int = 10) -> DataFrame:
    """reach() over defined nodes only (column 'node'); here a depth of 0 gives the entries alone."""
    if max_depth <= 0:
        return starts.select("entry", F.col("entry").alias("node")).distinct().withColumn("depth", F.lit(0))
    d = defined.select("node").distinct()
    inner = edges.join(d.withColumnRenamed("node", "src"), "src", "left_semi").join(d.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return reach(inner, starts, max_depth)


def callers(edges: DataFrame, targets: DataFrame, max_depth: int = 0) -> DataFrame:
    return reach(reversed_edges(edges), targets, max_depth)


def nearest_source(edges: DataFrame, sources: DataFrame, max_depth: int) -> DataFrame:
    """(node, source, steps): the nearest source that leads to each node, by at most max_depth + 1 edges; ties by name."""
    r = reach(edges, sources, max_depth + 1)
    return r.groupBy("node").agg(F.min_by("entry", F.struct("depth", "entry")).alias("source"), F.min("depth").alias("steps"))


def shortest_path(edges: DataFrame, source, target, max_depth: int = 50) -> DataFrame:
    """(pos, node) of one shortest path, of several the one with the least parents; no rows if there is none."""
    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    node = edges.schema["src"].dataType
    start = spark.createDataFrame([(source,)], ["entry"]).select(F.col("entry").cast(node).alias("entry"))
    seen = cut(reach(e, start, max_depth).select("node", "depth"))
    # walk back level by level, keeping the least parent; a path has one row per step
    path = seen.where(F.col("node") == F.lit(target).cast(node)).select(F.array("node").alias("path"), "node", "depth")
    n = path.first()
    for _ in range(n["depth"] if n else 0):
        up = path.join(e, path["node"] == e["dst"]).join(seen.select(F.col("node").alias("p"), F.col("depth").alias("pd")), F.col("src") == F.col("p")).where("pd = depth - 1")
        path = cut(up.groupBy("path").agg(F.min("p").alias("node"), F.min("pd").alias("depth")).select(F.concat(F.array("node"), "path").alias("path"), "node", "depth"))
    return path.select(F.posexplode("path").alias("pos", "node"))


def simple_paths(edges: DataFrame, source, target, max_nodes: int, most: int = 100) -> DataFrame:
    """Paths without repeated nodes, of at most max_nodes nodes, as arrays; the shortest, then least, `most` of them."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    node = edges.schema["src"].dataType
    spark = edges.sparkSession
    t = F.lit(target).cast(node)
    front = spark.createDataFrame([(source,)], ["a"]).select(F.array(F.col("a").cast(node)).alias("path"))
    done = front.where(F.element_at("path", -1) == t)
    # only nodes that can still lead to the target are followed
    useful = cut(callers(e, spark.createDataFrame([(target,)], ["entry"]).select(F.col("entry").cast(node).alias("entry")), max_nodes - 1).select(F.col("node").alias("u"), F.col("depth").alias("left")))
    for k in range(2, max_nodes + 1):
        front = front.where(F.element_at("path", -1) != t).join(e, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        front = cut(front.join(useful, (F.col("dst") == F.col("u")) & (F.col("left") <= max_nodes - k)).select(F.concat("path", F.array("dst")).alias("path")))
        done = done.union(front.where(F.element_at("path", -1) == t))
    return done.orderBy(F.size("path"), "path").limit(most)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of two or more nodes, named by their greatest node.

    Nodes without a predecessor or successor are trimmed; greatest labels flow along edges, and a node
    that flows back to its label inside the label's nodes is of that component.
    """
    e = cut(edges.select("src", "dst").where("src <> dst AND src IS NOT NULL AND dst IS NOT NULL").distinct())
    found = None
    while True:
        while True:  # trim
            n = e.count()
            t = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            e = cut(t.join(t.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            if e.count() == n:
                break
        if n == 0:
            break
        color = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("color", F.col("node")))
        while True:
            up = e.join(color, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("c"))
            nxt = cut(color.join(up, "node", "left").select("node", F.greatest("color", F.coalesce("c", "color")).alias("color"), (F.col("c") > F.col("color")).alias("moved")))
            color, moved = nxt.select("node", "color"), nxt.where("moved").isEmpty()
            if moved:
                break
        same = cut(e.join(color.select(F.col("node").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("cd")), "dst").where("cs = cd").select("src", "dst"))
        back = reach(reversed_edges(same), color.where("node = color").select(F.col("node").alias("entry")))
        part = cut(back.select("node", F.col("entry").alias("component")))
        found = part if found is None else found.union(part)
        e = cut(e.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if found is None:
        return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    many = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(many.select("component"), "component", "left_semi").select("node", "component")


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): callees first, level 0 for nodes that call nothing; nodes on or above a cycle have level -1.

    A node is ready once all its edges have been passed back from ready callees.  A round shuffles the edges of
    its new nodes only; counts so far lie by node.  There are as many rounds as levels.
    """
    e = cut(edges.select("src", "dst").where("src <> dst AND src IS NOT NULL AND dst IS NOT NULL").distinct())
    need = placed(e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("need")), "node")
    back, heavy = _by_source(reversed_edges(e))
    out = frontier = placed(e.select(F.col("dst").alias("node")).distinct().join(need.select("node"), "node", "left_anti").withColumn("level", F.lit(0)), "node")
    passed, level = None, 0
    while not frontier.isEmpty():
        level += 1
        got = placed(_ask(frontier.select("node"), heavy).join(back, ["node", "part"]).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("c")))
        passed = got if passed is None else passed.unionByName(got)
        sums = passed.join(got.select("node"), "node", "left_semi").groupBy("node").agg(F.sum("c").alias("c"))
        frontier = placed(sums.join(need, "node").where("c = need").select("node", F.lit(level).alias("level")))
        out = out.unionByName(frontier)
        if level % 8 == 0:
            passed, out = placed(passed.groupBy("node").agg(F.sum("c").alias("c"))), placed(out)
    return out.unionByName(need.select("node").join(out.select("node"), "node", "left_anti").withColumn("level", F.lit(-1)))


def leaves(edges: DataFrame) -> DataFrame:
    """Called nodes that call nothing."""
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def roots(edges: DataFrame) -> DataFrame:
    """Calling nodes that nothing calls."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def entries(edges: DataFrame, defined: DataFrame) -> DataFrame:
    """Roots, and defined nodes (column 'node') that no defined node calls."""
    d = defined.select("node").distinct()
    called = edges.join(d.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return roots(edges).union(d.join(called, "node", "left_anti")).distinct()


def neighbours(edges: DataFrame, node) -> DataFrame:
    """(direction, node) of the callers and callees of one node."""
    a = edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("node"))
    return a.union(edges.where(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("node"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out) by distinct edges."""
    e = edges.select("src", "dst").distinct()
    long = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(e.select("dst", F.lit(1), F.lit(0)))
    return long.groupBy("node").agg(F.sum("i").cast("bigint").alias("n_in"), F.sum("o").cast("bigint").alias("n_out"))


def bottlenecks(edges: DataFrame, least: int = 3) -> DataFrame:
    """Nodes with at least so many callers and callees, with the product of both."""
    return degrees(edges).where((F.col("n_in") >= least) & (F.col("n_out") >= least)).withColumn("score", F.col("n_in") * F.col("n_out"))


def graph_stats(edges: DataFrame, defined: DataFrame) -> DataFrame:
    """One row: nodes, defined nodes, edges, density of the defined graph."""
    d = defined.select("node").distinct()
    e = edges.select("src", "dst").distinct()
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).union(d).distinct()
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.lit(1).alias("k"))
    m = e.agg(F.count(F.lit(1)).alias("edges"), F.lit(1).alias("k"))
    f = d.agg(F.count(F.lit(1)).alias("defined"), F.lit(1).alias("k"))
    out = n.join(m, "k").join(f, "k").drop("k")
    return out.withColumn("density", F.when(F.col("defined") > 1, F.col("edges") / (F.col("defined") * (F.col("defined") - 1))).otherwise(F.lit(0.0)))


def depth_histogram(reached: DataFrame) -> DataFrame:
    """(depth, n) summed over entries."""
    return reached.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def danger_reach(reached: DataFrame, marks: DataFrame) -> DataFrame:
    """(entry, refs, apis, first_depth) of what an entry reaches: all marks, distinct ones, least depth.  marks: (node, api)."""
    j = reached.join(marks, "node")
    return j.groupBy("entry").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("api").alias("apis"), F.min("depth").alias("first_depth"))


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes (column 'node')."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def module_edges(edges: DataFrame, loaded: DataFrame) -> DataFrame:
    """(module, dst_module) pairs between loaded modules (column 'module'), none to itself."""
    e = external(edges).select("module", "dst_module").where("module <> dst_module").distinct()
    m = loaded.select("module").distinct()
    return e.join(m, "module", "left_semi").join(m.withColumnRenamed("module", "dst_module"), "dst_module", "left_semi").select("module", "dst_module")


def follow_chain(links: DataFrame, starts: DataFrame, hops: int = 5) -> DataFrame:
    """(start, hop, node): follow src -> dst from each start (column 'start') until it ends, repeats, or `hops` steps.

    A source with several targets follows the least one.
    """
    nxt = links.groupBy("src").agg(F.min("dst").alias("dst"))
    cur = starts.select("start", F.array("start").alias("path")).distinct()
    out = cur
    for _ in range(hops):
        cur = cut(cur.join(nxt, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("start", F.concat("path", F.array("dst")).alias("path")))
        out = out.union(cur)
    longest = out.groupBy("start").agg(F.max_by("path", F.size("path")).alias("path"))
    return longest.select("start", F.posexplode("path").alias("hop", "node"))


def trust_transitions(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(module, dst_module, transition) of module edges by the ranks (module, rank) of both ends."""
    a = ranks.select("module", F.col("rank").alias("ra"))
    b = ranks.select(F.col("module").alias("dst_module"), F.col("rank").alias("rb"))
    kind = F.when(F.col("rb") > F.col("ra"), "escalation").when(F.col("rb") < F.col("ra"), "drop").otherwise("same")
    return edges.join(a, "module").join(b, "dst_module").select("module", "dst_module", kind.alias("transition"))


def unified_edges(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Edges of several kinds (src, dst) in one table with their kind."""
    out = None
    for kind, e in parts:
        t = e.select("src", "dst", F.lit(kind).alias("edge_type"))
        out = t if out is None else out.unionByName(t)
    return out
