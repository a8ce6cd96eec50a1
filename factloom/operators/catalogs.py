"""Catalogs of interfaces and their servers: nested objects to dimension tables, lookups and edge synthesis."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import relational as R
from factloom.operators.scoring import risk_tier

INTERFACE = (
    "struct<interface_id:string,interface_version:string,procedure_count:int,offset:bigint,is_client:boolean,service_name:string,"
    "is_service_running:boolean,endpoints:array<string>>"
)
CATALOG = f"map<string,struct<binary_path:string,interfaces:array<{INTERFACE}>,procedures:array<string>>>"

#: Found in a procedure list where a name is missing.
_HEX = r"^(0x)?[0-9a-fA-F]{6,}$"


def mentions(text: Column, pattern: str) -> Column:
    """Distinct matches of a pattern's first group in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def binaries(catalog_text: DataFrame, column: str) -> DataFrame:
    """(path, module, interfaces, procedures) of each binary of catalogs that are JSON objects by path; broken texts give none."""
    m = catalog_text.select(F.explode(F.from_json(column, CATALOG)).alias("path", "b"))
    name = F.lower(F.regexp_extract("path", r"([^/\\]*)$", 1))
    procs = F.filter(F.coalesce("b.procedures", F.array().cast("array<string>")), lambda p: ~p.rlike(_HEX))
    return m.select("path", name.alias("module"), F.col("b.interfaces").alias("interfaces"), procs.alias("procedures"))


def interfaces(b: DataFrame) -> DataFrame:
    """One row per interface of each binary, with its protocols and risk tier."""
    i = b.select("path", "module", F.inline("interfaces"))
    protocols = F.array_distinct(F.transform(F.coalesce("endpoints", F.array().cast("array<string>")), lambda e: F.lower(F.split_part(e, F.lit(":"), F.lit(1)))))
    i = i.withColumn("protocols", protocols)
    has = lambda *p: F.arrays_overlap("protocols", F.array(*map(F.lit, p)))
    tier = risk_tier(
        [("critical", has("ncacn_ip_tcp", "ncacn_http")), ("high", has("ncacn_np")), ("medium", has("ncalrpc") & F.coalesce("is_service_running", F.lit(False)))],
    )
    return i.withColumn("tier", tier)


def procedures(b: DataFrame) -> DataFrame:
    """(module, interface_id, procedure): each binary's ordered procedures cut into its interfaces by their counts."""
    owners = b.select("path", "module", F.inline("interfaces")).select("path", "module", "interface_id", F.col("procedure_count").alias("size"), "offset")
    items = b.select("path", F.posexplode("procedures").alias("pos", "procedure"))
    return R.interval_assignment(owners, items, "path", "offset", "size", "pos").select("module", "interface_id", "procedure")


def by_tier(i: DataFrame) -> DataFrame:
    return i.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("module").alias("modules"))


def by_service(i: DataFrame) -> DataFrame:
    return i.groupBy(F.coalesce("service_name", F.lit("(no service)")).alias("service")).agg(F.count_distinct("interface_id").alias("n"))


def topology(i: DataFrame) -> DataFrame:
    """Servers and clients of each interface, with their numbers."""
    side = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("module"))))
    client = F.coalesce("is_client", F.lit(False))
    return i.groupBy(F.lower("interface_id").alias("interface_id")).agg(side(~client).alias("servers"), side(client).alias("clients"), F.min("service_name").alias("service"))


def blast_radius(i: DataFrame, targets: DataFrame) -> DataFrame:
    """(interface_id, sibling): interfaces that share a service or a binary with a target (column interface_id), without itself."""
    return R.siblings(i.select("interface_id", "service_name", "path"), targets, "interface_id", ["service_name", "path"])


def client_edges(i: DataFrame, p: DataFrame) -> DataFrame:
    """(src_module, dst_module, procedure): clients of an interface to each procedure of its servers."""
    client = F.coalesce("is_client", F.lit(False))
    c = i.where(client).select(F.lower("interface_id").alias("u"), F.col("module").alias("src_module")).distinct()
    s = p.select(F.lower("interface_id").alias("u"), F.col("module").alias("dst_module"), "procedure").distinct()
    return c.join(s, "u").where("src_module <> dst_module").select("src_module", "dst_module", "procedure").distinct()


def in_strings(strings: DataFrame, column: str, i: DataFrame) -> DataFrame:
    """(string, interface_id, how): interfaces whose id or endpoint a string holds; a string with two gives two rows."""
    uuid = r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"
    u = strings.select(column, F.explode(mentions(F.col(column), uuid)).alias("u")).withColumn("u", F.lower("u"))
    ids = i.select(F.lower("interface_id").alias("u"), "interface_id").distinct()
    e = i.select("interface_id", F.explode("endpoints").alias("endpoint")).withColumn("endpoint", F.lower("endpoint"))
    whole = strings.select(column, F.lower(column).alias("endpoint"))
    return u.join(ids, "u").select(column, "interface_id", F.lit("uuid").alias("how")).unionAll(whole.join(e, "endpoint").select(column, "interface_id", F.lit("endpoint")))


def present_in(modules: DataFrame, catalogs: Mapping[str, DataFrame]) -> DataFrame:
    """(kind, module) of the modules that each catalog (a table with a column module) knows, each once."""
    m = modules.select(F.lower("module").alias("module")).distinct()
    parts = [R.in_keys(m, c.select(F.lower("module").alias("module")), ["module"]).select(F.lit(kind).alias("kind"), "module") for kind, c in catalogs.items()]
    return reduce(DataFrame.unionByName, parts)


def privileged(servers: DataFrame, contexts: DataFrame, level: str) -> DataFrame:
    """Servers that have a privileged context for callers of the level."""
    c = contexts.where((F.col("caller") == level) & F.col("privileged")).select("server").distinct()
    return servers.join(c, "server", "left_semi")


def aces(sddl: Column) -> Column:
    """The access entries of a security descriptor: array of (kind, rights, sid)."""
    found = F.regexp_extract_all(sddl, F.lit(r"\(([A-Z]+;[^;]*;[^;]*;[^;]*;[^;]*;[^;)]*)[^)]*\)"), F.lit(1))
    return F.transform(found, lambda a: F.struct(F.split_part(a, F.lit(";"), F.lit(1)).alias("kind"), F.split_part(a, F.lit(";"), F.lit(3)).alias("rights"), F.split_part(a, F.lit(";"), F.lit(6)).alias("sid")))


def permissive(sddl: Column, wide: tuple[str, ...] = ("WD", "AN", "BU", "AU", "IU")) -> Column:
    """Whether a wide group is allowed in and not denied."""
    a = aces(sddl)
    ids = lambda kind: F.transform(F.filter(a, lambda x: x["kind"] == kind), lambda x: x["sid"])
    allowed = F.array_intersect(ids("A"), F.array(*map(F.lit, wide)))
    return F.coalesce(F.size(F.array_except(allowed, ids("D"))) > 0, F.lit(False))


def methods_matching(methods: DataFrame, column: str, pattern: str) -> DataFrame:
    """Methods whose name matches a pattern in any case; a bad pattern matches none."""
    try:
        re.compile(pattern)
    except re.error:
        return methods.limit(0)
    return methods.where(F.col(column).rlike(f"(?i){pattern}"))


#: From the worst to the least.
TIERS = ("critical", "high", "medium", "low")


def best_tier(contexts: DataFrame) -> DataFrame:
    """(server, tier): the worst tier over a server's contexts (server, caller, privileged, remote)."""
    tier = risk_tier([("critical", F.col("privileged") & F.col("remote")), ("high", F.col("privileged") & (F.col("caller") == "low")), ("medium", F.col("privileged") | F.col("remote"))])
    place = F.array_position(F.array(*map(F.lit, TIERS)), tier)
    return contexts.groupBy("server").agg(F.min_by(tier, place).alias("tier"))


def flag_score(flags: Sequence[tuple[Column, float]], methods: Column, trivial: Column) -> Column:
    """The weights of a server's flags and .1 of its methods' number up to 20; 0 if it has only trivial methods."""
    total = F.lit(0.0)
    for c, w in flags:
        total = total + F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return F.when(methods <= trivial, 0.0).otherwise(F.least(F.lit(1.0), total + 0.1 * F.least(methods / 20, F.lit(1.0))))
