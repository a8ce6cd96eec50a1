"""Measures of parsed functions and their modules: loops, global state, references, errors, dependencies and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.model import xref_name

#: From this share of functions with dangerous calls on a module is flagged.
RISKY_SHARE = 0.3


def loop_metrics(functions: DataFrame) -> DataFrame:
    """(module, function_id, loops, nesting, complexity) of functions with loops: their number, and the greatest nesting and complexity."""
    most = lambda k: F.array_max(F.transform("loops.loops", lambda x: x[k])).cast("bigint")
    return functions.where("loops.loop_count > 0").select("module", "function_id", F.col("loops.loop_count").cast("bigint").alias("loops"), most("nesting_level").alias("nesting"), most("cyclomatic_complexity").alias("complexity"))


def global_state(functions: DataFrame, names: int = 10) -> DataFrame:
    """(module, function_id, reads, writes, names) of functions that touch globals; the first names in order."""
    n = lambda k: F.size(F.filter("globals", lambda x: F.lower(x["access_type"]) == k)).cast("bigint")
    first = F.slice(F.array_sort(F.array_distinct(F.transform("globals", lambda x: x["name"]))), 1, names)
    return functions.where(F.size("globals") > 0).select("module", "function_id", n("read").alias("reads"), n("write").alias("writes"), F.array_join(first, ",").alias("names"))


def shared_state(functions: DataFrame) -> DataFrame:
    """(name, readers, writers): how many functions read and write each global."""
    g = functions.select("module", "function_id", F.explode("globals").alias("g"))
    who = lambda k: F.count_distinct(F.when(F.lower("g.access_type") == k, F.struct("module", "function_id")))
    return g.groupBy(F.col("g.name").alias("name")).agg(who("read").alias("readers"), who("write").alias("writers"))


def xref_mix(functions: DataFrame) -> DataFrame:
    """(kind, n, names): outbound references by kind, and how many different names each leads to."""
    x = functions.select(F.explode("outbound").alias("x"))
    return x.groupBy(F.col("x.xref_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(xref_name(F.col("x"))).alias("names"))


def error_stage(errors: Column) -> Column:
    """The stage of the first error of a JSON text, a list or a lone object; 'none' without one."""
    v = F.try_parse_json(errors)
    return F.coalesce(F.try_variant_get(v, F.lit("$[0].stage"), "string"), F.try_variant_get(v, F.lit("$.stage"), "string"), F.lit("none"))


def dependency_edges(functions: DataFrame) -> DataFrame:
    """(module, target, calls, names) of references to other modules."""
    x = functions.select("module", F.explode("outbound").alias("x"))
    t = F.lower("x.module_name")
    return x.where((F.coalesce(t, F.lit("")) != "") & (t != F.col("module"))).groupBy("module", t.alias("target")).agg(F.count(F.lit(1)).alias("calls"), F.count_distinct(xref_name(F.col("x"))).alias("names"))


def fan(edges: DataFrame) -> DataFrame:
    """(module, fan_out, fan_in) of module edges (module, target)."""
    e = edges.select("module", "target").distinct()
    long = e.select("module", F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select("target", F.lit(0), F.lit(1)))
    return long.groupBy("module").agg(F.sum("o").cast("bigint").alias("fan_out"), F.sum("i").cast("bigint").alias("fan_in"))


def fingerprint(functions: DataFrame, risky: float = RISKY_SHARE) -> DataFrame:
    """(module, functions, risky_share, string_share, flagged) to 4 decimals."""
    c = functions.groupBy("module").agg(F.count(F.lit(1)).alias("functions"), F.count_if(F.size("dangerous") > 0).alias("risky"), F.count_if(F.size("strings") > 0).alias("stringy"))
    share = lambda k: F.col(k) / F.col("functions")
    return c.select("module", "functions", F.round(share("risky"), 4).alias("risky_share"), F.round(share("stringy"), 4).alias("string_share"), (share("risky") >= risky).alias("flagged"))
