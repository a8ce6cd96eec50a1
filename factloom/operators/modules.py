"""Imports and exports of modules: flat indexes, lookups, forwarders, dependencies and cross-module resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.model import EXPORTS, IMPORTS
from factloom.operators.graph import follow_chain
from factloom.operators.skew import lookup_join


def export_index(info: DataFrame) -> DataFrame:
    """(module, name, ordinal, forwarded, to_module, to_name) of module rows (module, exports as JSON).

    Both key spellings are read; broken lists give nothing.  A forwarder 'lib.Name' is split at its last dot;
    the target module gets .dll if it has no extension.
    """
    e = info.select(F.lower("module").alias("module"), F.explode(F.from_json("exports", EXPORTS)).alias("e"))
    to = F.col("e.forwarded_to")
    lib = F.lower(F.regexp_extract(to, r"^(.*)\.[^.]*$", 1))
    return e.select(
        "module",
        F.coalesce("e.function_name", "e.name").alias("name"),
        F.col("e.ordinal").alias("ordinal"),
        F.coalesce("e.is_forwarded", F.lit(False)).alias("forwarded"),
        F.when(lib != "", F.when(lib.rlike(r"\.(dll|exe|sys|ocx|drv)$"), lib).otherwise(F.concat(lib, F.lit(".dll")))).alias("to_module"),
        F.when(lib != "", F.regexp_extract(to, r"([^.]*)$", 1)).alias("to_name"),
    )


def import_index(info: DataFrame) -> DataFrame:
    """(module, from_module, name, delayed) of module rows (module, imports as JSON)."""
    i = info.select(F.lower("module").alias("module"), F.explode(F.from_json("imports", IMPORTS)).alias("i"))
    f = i.select("module", F.lower(F.coalesce("i.module_name", "i.name")).alias("from_module"), F.explode("i.functions").alias("f"))
    return f.select("module", "from_module", F.coalesce("f.function_name", "f.name").alias("name"), F.coalesce("f.is_delay_loaded", F.lit(False)).alias("delayed"))


def who_exports(exports: DataFrame, name: str) -> DataFrame:
    return exports.where(F.lower("name") == name.lower())


def who_imports(imports: DataFrame, name: str, from_module: str | None = None) -> DataFrame:
    out = imports.where(F.lower("name") == name.lower())
    return out.where(F.col("from_module") == from_module.lower()) if from_module else out


def index_summary(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """One row with totals and distinct names of both."""
    e = exports.agg(F.count(F.lit(1)).alias("exports"), F.count_if("forwarded").alias("forwarded"), F.count_distinct(F.lower("name")).alias("export_names"), F.lit(1).alias("k"))
    i = imports.agg(F.count(F.lit(1)).alias("imports"), F.count_distinct(F.lower("name")).alias("import_names"), F.count_distinct("module", "from_module").alias("edges"), F.lit(1).alias("k"))
    return e.join(i, "k").drop("k")


def dependencies(imports: DataFrame) -> DataFrame:
    """(module, from_module, names, delayed): one row per dependency; delayed if any of its names is."""
    return imports.groupBy("module", "from_module").agg(F.count_distinct(F.lower("name")).alias("names"), F.bool_or("delayed").alias("delayed"))


def consumers(imports: DataFrame, module: str) -> DataFrame:
    return imports.where(F.col("from_module") == module.lower()).groupBy("module").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def suppliers(imports: DataFrame, module: str) -> DataFrame:
    return imports.where(F.col("module") == module.lower()).groupBy("from_module").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def forwarder_chains(exports: DataFrame, hops: int = 5) -> DataFrame:
    """(start, hop, node) for each forwarded export, nodes written module!name in lower case; cycles end the chain."""
    node = lambda m, n: F.concat_ws("!", F.lower(m), F.lower(n))
    links = exports.where("forwarded AND to_module IS NOT NULL").select(node(F.col("module"), F.col("name")).alias("src"), node(F.col("to_module"), F.col("to_name")).alias("dst"))
    return follow_chain(links, links.select(F.col("src").alias("start")), hops)


def resolved(wanted: DataFrame, functions: DataFrame, exports: DataFrame) -> DataFrame:
    """(name, module, how): modules that define a wanted name in any case, else that export it as a forwarder.

    wanted: (name); functions: (module, function_name).  A name in neither has no row.
    """
    w = wanted.select("name", F.lower("name").alias("__n")).distinct()
    direct = w.join(functions.select("module", F.lower("function_name").alias("__n")).distinct(), "__n").select("name", "module", F.lit("defined").alias("how"))
    rest = w.join(direct.select("name").distinct(), "name", "left_anti")
    forward = rest.join(exports.where("forwarded").select(F.lower("name").alias("__n"), F.col("to_module").alias("module")).distinct(), "__n").select("name", "module", F.lit("forwarded").alias("how"))
    return direct.union(forward)


def export_functions(exports: DataFrame, functions: DataFrame) -> DataFrame:
    """(module, name, kind, function_id): exports with the function behind them; of several of the name the least id."""
    f = functions.groupBy("module", F.lower("function_name").alias("__n")).agg(F.min("function_id").alias("function_id"))
    kind = F.when(F.col("forwarded"), "forwarded").when(F.coalesce("name", F.lit("")) == "", "ordinal").when(F.lower("name").isin("dllgetclassobject", "dllgetactivationfactory"), "factory").otherwise("plain")
    return lookup_join(exports.withColumn("__n", F.lower("name")), f, ["module", "__n"], "left").select("module", "name", kind.alias("kind"), "function_id")


def shared_functions(calls: DataFrame, a: str, b: str) -> DataFrame:
    """(src_module, dst_module, name): functions that either of two modules calls in the other.  calls: (module, dst_module, dst)."""
    x, y = a.lower(), b.lower()
    two = ((F.col("module") == x) & (F.col("dst_module") == y)) | ((F.col("module") == y) & (F.col("dst_module") == x))
    return calls.where(two).select(F.col("module").alias("src_module"), "dst_module", F.col("dst").alias("name")).distinct()


def calling_modules(calls: DataFrame, name_part: str, modules: Sequence[str] | None = None) -> DataFrame:
    """Calls whose target's name holds a text in any case."""
    c = calls.where(F.contains(F.lower("dst"), F.lit(name_part.lower())))
    return c.where(F.col("module").isin([m.lower() for m in modules])) if modules is not None else c


#: The node that stands for every server where a client's own one isn't known.
ANY_SERVER = "(any server)"


def fallback_edges(edges: DataFrame, clients: DataFrame, servers: DataFrame) -> DataFrame:
    """(src_module, dst_module): the given edges; only if there are none, each client may reach each server.

    The fallback goes through one node, ANY_SERVER, so it has as many edges as clients and servers
    together, not as many as their pairs; reach over it needs one step more.
    """
    if not edges.isEmpty():
        return edges.select("src_module", "dst_module").distinct()
    c = clients.select(F.lower("module").alias("src_module"), F.lit(ANY_SERVER).alias("dst_module")).distinct()
    return c.union(servers.select(F.lit(ANY_SERVER), F.lower("module")).distinct())


def activation_edges(sites: DataFrame, servers: DataFrame) -> DataFrame:
    """(src_module, dst_module, procedure, edge_type) of call sites (module, class_id) to the servers (class_id, module, procedure).

    A site whose class is known leads to that class's procedures; modules with other sites lead to ANY_SERVER
    once (edge_type 'unresolved'), and that to every server, so the broad edges aren't a product.  No edge leads to its own module.
    """
    s = servers.select(F.lower("class_id").alias("__c"), F.lower("module").alias("dst_module"), "procedure").where("__c IS NOT NULL").distinct()
    c = sites.select(F.lower("module").alias("src_module"), F.lower("class_id").alias("__c")).distinct()
    known = lookup_join(c, s, ["__c"]).where("src_module <> dst_module").select("src_module", "dst_module", "procedure", F.lit("resolved").alias("edge_type"))
    ids = s.select("__c").distinct()
    lost = c.where("__c IS NULL").unionByName(lookup_join(c.where("__c IS NOT NULL"), ids, ["__c"], "left_anti"))
    none = F.lit(None).cast("string")
    broad = lost.select("src_module", F.lit(ANY_SERVER).alias("dst_module"), none.alias("procedure"), F.lit("unresolved").alias("edge_type")).distinct()
    hub = s.select(F.lit(ANY_SERVER).alias("src_module"), "dst_module", "procedure", F.lit("unresolved").alias("edge_type")).distinct()
    return known.distinct().union(broad).union(hub if not broad.isEmpty() else hub.limit(0))


def callbacks(edges: DataFrame, registrars: DataFrame, hints: str, most_callers: int = 5, lone: int = 2) -> DataFrame:
    """(node, by, api): callees of functions that call a registration API, if few call them or their name hints at it.

    edges: (src, dst); registrars: (node, api, pos).  The first API by position, then name, gives the type.
    """
    fan = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("callers"))
    c = edges.join(registrars.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.col("src").alias("by"), "api", "pos").join(fan, "node")
    c = c.where((F.col("callers") <= most_callers) & (F.lower("node").rlike(hints) | (F.col("callers") <= lone)))
    return c.groupBy("node").agg(F.min_by(F.struct("by", "api"), F.struct("pos", "api", "by")).alias("b")).select("node", "b.by", "b.api")


def one_per_category(items: DataFrame, category: str, order: str, most: int) -> DataFrame:
    """The first item of each category by order, and of those the first `most`."""
    r = items.withColumn("__r", F.row_number().over(W.partitionBy(category).orderBy(order))).where("__r = 1").drop("__r")
    return r.orderBy(order).limit(most)


def first_per_category(items: DataFrame, keys: Sequence[str], category: str, order: Sequence[str], most: int) -> DataFrame:
    """The same for every key: the first item of each category, and of those the first `most` of the key."""
    r = items.withColumn("__r", F.row_number().over(W.partitionBy(*keys, category).orderBy(*order))).where("__r = 1")
    return r.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def caller_boost(scores: DataFrame, calls: DataFrame, key: str = "name", step: float = 0.05, most: float = 0.15) -> DataFrame:
    """scores with the number of modules that call each (module, key) from outside, and a bounded boost for it."""
    n = calls.where("module <> dst_module").groupBy(F.col("dst_module").alias("module"), F.col("dst").alias(key)).agg(F.count_distinct("module").alias("outside"))
    j = scores.join(n, ["module", key], "left").withColumn("outside", F.coalesce("outside", F.lit(0)))
    return j.withColumn("score", F.least(F.lit(1.0), F.col("score") + F.least(F.lit(most), F.col("outside") * step)))


def classified(names: DataFrame, column: str, prefixes: DataFrame) -> DataFrame:
    """names with the class of the longest prefix that the table (prefix, class) has for it, null without one.

    Each distinct name is cut to the lengths that prefixes have, so the match is an equality join, whatever
    the number of prefixes.
    """
    p = prefixes.select(F.col("prefix").alias("p"), "class").where(F.length("prefix") > 0).groupBy("p").agg(F.min("class").alias("class"))
    # the lengths that prefixes of a first letter have, so that a name isn't cut to others
    lengths = p.groupBy(F.substring("p", 1, 1).alias("__a")).agg(F.collect_set(F.length("p")).alias("__ks"))
    n = names.select(F.col(column).alias("__name"), F.substring(column, 1, 1).alias("__a")).where(F.col(column).isNotNull()).distinct()
    c = lookup_join(n, lengths, ["__a"], spread_by=["__name"]).select("__name", F.explode(F.filter("__ks", lambda k: k <= F.length("__name"))).alias("k"))
    hit = lookup_join(c.select("__name", "k", F.expr("substring(__name, 1, k)").alias("p")), p, ["p"], spread_by=["__name", "k"]).groupBy("__name").agg(F.max_by("class", "k").alias("class"))
    return names.join(hit, F.col(column) == F.col("__name"), "left").drop("__name")


def prefixed(c: Column, suffixes: Sequence[str] = ("", "A", "W", "Ex", "ExA", "ExW")) -> Column:
    """The usual variants of a name."""
    return F.transform(F.array(*map(F.lit, suffixes)), lambda s: F.concat(c, s))


def import_analysis(imports: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(module, class, names, from_modules, delayed) of imports by the class of their names; unclassified as 'other'."""
    c = classified(imports, "name", prefixes).withColumn("class", F.coalesce("class", F.lit("other")))
    return c.groupBy("module", "class").agg(F.count_distinct("name").alias("names"), F.count_distinct("from_module").alias("from_modules"), F.bool_or("delayed").alias("delayed"))
