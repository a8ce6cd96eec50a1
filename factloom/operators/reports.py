"""Reports composed of graph, join and aggregate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import graph as G
from factloom.session import cut


def topology(edges: DataFrame, defined: DataFrame, starts: DataFrame, depth: int = 8) -> dict[str, DataFrame]:
    """Graph statistics, depth histogram over all entries, bottlenecks, leaves, roots and dead nodes.

    starts: (entry).  Dead nodes are defined ones that no other node calls and that are no entry.
    """
    e = cut(edges.select("src", "dst").distinct())
    r = G.reach(e, starts, depth)
    called = e.where("src <> dst").select(F.col("dst").alias("node")).distinct()
    dead = defined.select("node").distinct().join(called, "node", "left_anti").join(starts.select(F.col("entry").alias("node")), "node", "left_anti")
    return {"stats": G.graph_stats(e, defined), "depths": G.depth_histogram(r), "bottlenecks": G.bottlenecks(e), "leaves": G.leaves(e), "roots": G.roots(e), "dead": dead}


def transitive_calls(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(entry, name): names called by anything within `depth` steps of an entry."""
    return G.reach(edges, starts, depth).join(edges.select(F.col("src").alias("node"), F.col("dst").alias("name")), "node").select("entry", "name").distinct()


def handler_audit(calls: DataFrame, required: list[str], forbidden: list[str]) -> DataFrame:
    """(entry, missing, found, verdict) of transitive calls by lists of names that have to be there, or must not."""
    g = calls.groupBy("entry").agg(F.collect_set(F.when(F.col("name").isin(*required, *forbidden), F.col("name"))).alias("n"))
    lit = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    missing, found = F.array_sort(F.array_except(lit(required), "n")), F.array_sort(F.array_intersect(lit(forbidden), "n"))
    verdict = F.when((F.size(missing) > 0) & (F.size(found) > 0), "high").when(F.size(found) > 0, "medium").when(F.size(missing) > 0, "low").otherwise("ok")
    return g.select("entry", F.array_join(missing, ",").alias("missing"), F.array_join(found, ",").alias("found"), verdict.alias("verdict"))


def traversal_plan(reached: DataFrame, kinds: DataFrame, values: list[str]) -> DataFrame:
    """A row per depth with the number of nodes of each kind; nodes without a kind count as 'other'."""
    r = reached.join(kinds, "node", "left").withColumn("kind", F.when(F.col("kind").isin(values), F.col("kind")).otherwise("other"))
    return r.groupBy("depth").pivot("kind", [*values, "other"]).agg(F.count(F.lit(1))).fillna(0)


def call_tree(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(parent, child, depth, kind): each node once, under its least parent at the depth before; kind: internal or external.

    edges: (src, dst, dst_module).
    """
    r = G.reach(edges, start, depth)
    at = r.select(F.col("node"), F.col("depth").alias("d"))
    up = edges.join(at.withColumnRenamed("node", "src"), "src").join(at.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst").where("dd = d + 1")
    kind = F.when(F.coalesce(F.max("dst_module"), F.lit("")) == "", "internal").otherwise("external")
    return up.groupBy("dst").agg(F.min("src").alias("parent"), F.min("dd").alias("depth"), kind.alias("kind")).select("parent", F.col("dst").alias("child"), "depth", "kind")


def cross_module_reach(calls: DataFrame, ipc: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(entry, module, name, depth) over internal and external calls and edges between modules.

    calls: (module, src, dst_module, dst), with a null or empty dst_module for the own module; ipc: (src_module,
    dst_module, procedure), open to every function of the client module.  Nodes are written module!name.  A
    function is reported once, under its real module.
    """
    own = F.when(F.coalesce("dst_module", F.lit("")) == "", F.col("module")).otherwise(F.lower("dst_module"))
    node = lambda m, n: F.concat_ws("!", m, n)
    direct = calls.select(node(F.col("module"), F.col("src")).alias("src"), node(own, F.col("dst")).alias("dst"))
    # an edge between modules costs one step through the client module's gate, not one per function
    to_gate = calls.select("module", "src").distinct().join(ipc.select(F.lower("src_module").alias("module")).distinct(), "module", "left_semi")
    gates = to_gate.select(node(F.col("module"), F.col("src")).alias("src"), F.concat(F.lit("gate:"), "module").alias("dst"))
    through = ipc.select(F.concat(F.lit("gate:"), F.lower("src_module")).alias("src"), node(F.lower("dst_module"), F.col("procedure")).alias("dst"))
    r = G.reach(direct.union(gates).union(through), starts, depth)
    return r.where(~F.col("node").startswith("gate:")).select("entry", F.split_part("node", F.lit("!"), F.lit(1)).alias("module"), F.split_part("node", F.lit("!"), F.lit(2)).alias("name"), "depth")


def dossier(edges: DataFrame, entries: DataFrame, marks: DataFrame, node: str, depth: int = 5) -> dict[str, DataFrame]:
    """What is known of one node: its callers, neighbours, nearest entry, and the marks that it reaches."""
    one = edges.sparkSession.createDataFrame([(node,)], "entry string")
    near = G.nearest_source(edges, entries, depth).where(F.col("node") == node)
    return {"callers": G.callers(edges, one, depth), "neighbours": G.neighbours(edges, node), "nearest_entry": near, "danger": G.danger_reach(G.reach(edges, one, depth), marks)}
