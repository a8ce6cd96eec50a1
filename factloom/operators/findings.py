"""Findings of several scanners in one schema, entries found by several sources, and scores by how they are reached."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import relational as R
from factloom.operators.scoring import CONFIDENCE

# Scores of severities that come without a number.
SEVERITY_SCORES = {"CRITICAL": 0.95, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.2}
# What kind of sink a category of logic or memory faults leads to; others are uncategorized_dangerous.
LOGIC_SINKS = {
    "auth_bypass_missing_check": "privilege",
    "auth_bypass_ordering": "privilege",
    "missing_auth": "privilege",
    "auth_after_action": "privilege",
    "impersonation_leak": "privilege",
    "confused_deputy": "privilege",
    "error_path_priv_leak": "privilege",
    "toctou_race_condition": "memory_unsafe",
    "toctou_double_fetch": "memory_unsafe",
}
OTHER_SINK = "uncategorized_dangerous"
# Where a reach by the kind of entry begins.
REACH = {
    "rpc_handler": 1.0, "com_method": 1.0, "winrt_method": 1.0, "transitive_rpc": 0.85, "transitive_com": 0.85, "transitive_winrt": 0.85,
    "export": 0.75, "entry_point": 0.75,
}
GRADUATED = {"rpc_handler": 1.0, "com_method": 0.9, "export": 0.75, "entry_point": 0.8}
# What an entry's kind adds, and protocols that do.
ENTRY_KINDS = {
    "rpc_handler": 0.9, "named_pipe_handler": 0.85, "tcp_udp_handler": 0.85, "ipc_dispatcher": 0.8, "com_method": 0.7, "winrt_method": 0.65, "com_class_factory": 0.7, "window_proc": 0.6,
    "service_main": 0.6, "service_ctrl_handler": 0.55, "callback_registration": 0.5, "scheduled_callback": 0.5, "hook_procedure": 0.65, "tls_callback": 0.6, "exception_handler": 0.4,
    "dllmain": 0.5, "main_entry": 0.5, "driver_dispatch": 0.9, "export_dll": 0.3, "export_ordinal_only": 0.35, "forwarded_export": 0.3,
}
PROTOCOLS = {"ncacn_ip_tcp": 0.95, "ncacn_http": 0.95, "ncacn_np": 0.85}
PRIVILEGED_TRUST = ("system_service", "rpc_server", "kernel_adjacent")

#: The columns of a finding that every adapter gives.
FINDING = ("function_name", "source_type", "source_category", "sink", "sink_category", "severity", "score")


def _pick(table: Mapping[str, object], key: Column, otherwise) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(otherwise))


def severity_word(c: Column) -> Column:
    """The level that a text begins with, in upper case; MEDIUM for anything else."""
    w = F.upper(F.split_part(F.trim(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(1)))
    return F.when(w.isin(list(SEVERITY_SCORES)), w).otherwise("MEDIUM")


# ---------------------------------------------------------------- one schema for all scanners


def from_taint(f: DataFrame) -> DataFrame:
    """Findings of a taint scanner: (function_name, sink, sink_category, severity, score); what lacks gets its default."""
    d = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return f.select(d("function_name", "?"), F.lit("taint").alias("source_type"), F.coalesce("sink_category", F.lit("")).alias("source_category"), d("sink", "?"), d("sink_category", OTHER_SINK), d("severity", "MEDIUM"), d("score", 0.3))


def from_memory(f: DataFrame) -> DataFrame:
    """Findings of a memory scanner: (function_name, category, dangerous_api, severity, score)."""
    c = F.coalesce("category", F.lit(""))
    return f.select(
        F.coalesce("function_name", F.lit("?")).alias("function_name"), F.lit("memory_corruption").alias("source_type"), c.alias("source_category"), F.coalesce("dangerous_api", c).alias("sink"),
        F.lit("memory_unsafe").alias("sink_category"), F.coalesce("severity", F.lit("MEDIUM")).alias("severity"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def from_logic(f: DataFrame) -> DataFrame:
    """Findings of a logic scanner: (vulnerability_type, affected_functions, entry_point, severity_assessment); the score comes from the severity's word."""
    s = severity_word(F.col("severity_assessment"))
    kind = F.coalesce("vulnerability_type", F.lit(""))
    return f.select(
        F.coalesce(F.get("affected_functions", F.lit(0)), "entry_point", F.lit("?")).alias("function_name"), F.lit("logic_vulnerability").alias("source_type"), kind.alias("source_category"), kind.alias("sink"),
        F.lit("logic_unsafe").alias("sink_category"), s.alias("severity"), _pick(SEVERITY_SCORES, s, 0.5).alias("score"),
    )


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"taint": from_taint, "memory_corruption": from_memory, "logic_vulnerability": from_logic}


def normalised(outputs: Mapping[str, DataFrame], adapters: Mapping[str, Callable[[DataFrame], DataFrame]] = ADAPTERS) -> DataFrame:
    """Outputs of scanners by kind in one table; kinds without an adapter are left out."""
    known = [adapters[k](df) for k, df in outputs.items() if k in adapters]
    if not known:
        raise ValueError("no output of a known kind")
    return reduce(DataFrame.unionByName, known)


def for_assessment(findings: DataFrame) -> DataFrame:
    """Normalised findings as an assessment takes them: the kind of sink by source, and a path of one hop at least."""
    sink = F.when(F.col("source_type") == "taint", F.col("sink_category")).when(F.col("source_type") == "memory_corruption", "memory_unsafe").otherwise(_pick(LOGIC_SINKS, F.col("source_category"), OTHER_SINK))
    return findings.withColumn("sink_category", sink).withColumn("path_hops", F.lit(1))


def verified_by(findings: DataFrame, category: str, verifiers: Mapping[str, Callable[[DataFrame], Column]], otherwise: str = "UNCERTAIN") -> DataFrame:
    """findings with a column confidence, by the verifier of their category; categories without one get the default.

    Verifiers give a Column from the table, so that all of them run in one pass.
    """
    out = None
    for name, v in verifiers.items():
        hit = F.col(category) == name
        out = F.when(hit, v(findings)) if out is None else out.when(hit, v(findings))
    return findings.withColumn("confidence", F.coalesce(out, F.lit(otherwise)) if out is not None else F.lit(otherwise))


# ---------------------------------------------------------------- reach


def reach_context(rpc: Column, com: Column, winrt: Column, from_rpc: Column, from_com: Column, from_winrt: Column, exported: Column, entry: Column) -> Column:
    """The kind of reach: a handler's own before one that handlers lead to, before exports, before other entries; null if none."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(rpc), "rpc_handler").when(yes(com), "com_method").when(yes(winrt), "winrt_method").when(yes(from_rpc), "transitive_rpc").when(yes(from_com), "transitive_com").when(yes(from_winrt), "transitive_winrt")
        .when(yes(exported), "export").when(yes(entry), "entry_point")
    )


def reach_score(kind: Column, elevates: Column, protocol: Column, graph_hops: Column, path_hops: Column) -> Column:
    """0 to 1: by the kind, more for elevation and for network protocols, less by the root of the hops to it and of the path's hops."""
    base = _pick(REACH, F.coalesce(kind, F.lit("")), 0.4)
    base = F.when(F.coalesce(elevates, F.lit(False)) & kind.isin("com_method", "transitive_com"), F.least(base * 1.15, F.lit(1.0))).otherwise(base)
    base = F.when(protocol.isin("ncacn_ip_tcp", "ncacn_http") & kind.isin("rpc_handler", "transitive_rpc"), F.least(base * 1.10, F.lit(1.0))).otherwise(base)
    base = F.when(graph_hops > 0, base / F.sqrt(F.greatest(graph_hops, F.lit(1)))).otherwise(base)
    return F.least(base / F.sqrt(F.greatest(path_hops, F.lit(1))), F.lit(1.0))


def graduated_reach(kind: Column, hops: Column) -> Column:
    """0 to 1 by the kind of entry and the hops to it; functions without one are at .4 to begin with."""
    base = _pick(GRADUATED, F.coalesce(kind, F.lit("")), 0.4)
    return F.least(base / F.sqrt(F.greatest(hops, F.lit(1)) + 1), F.lit(1.0))


def kind_score(kind: Column, trust: Column, protocols: Column, service: Column, tier: Column, elevates: Column) -> Column:
    """What an entry's kind adds: for handlers by protocol or privilege where known, else by the table of kinds.

    protocols: array of names.  Exports of a privileged module count .7 at least.
    """
    has = lambda p: F.coalesce(F.array_contains(protocols, p), F.lit(False))
    best = F.greatest(*[F.when(has(p), v).otherwise(0.0) for p, v in PROTOCOLS.items()])
    rpc = F.when(F.coalesce(F.size(protocols), F.lit(0)) <= 0, 0.9).otherwise(F.greatest(F.when(best > 0, best).when(service.isNotNull(), 0.75).otherwise(0.60), F.when(tier == "critical", 0.95).otherwise(0.0)))
    com = F.when(tier == "critical", 0.95).when(F.coalesce(elevates, F.lit(False)), 0.90).when((tier == "high") | service.isNotNull(), 0.80).when(tier.isNotNull(), 0.75)
    winrt = F.when(tier == "critical", 0.90).when(tier == "high", 0.80).when(tier.isNotNull(), 0.70)
    plain = _pick(ENTRY_KINDS, kind, 0.3)
    plain = F.when(trust.isin(*PRIVILEGED_TRUST) & kind.isin("export_dll", "export_ordinal_only", "forwarded_export"), F.greatest(plain, F.lit(0.7))).otherwise(plain)
    special = F.when(kind == "rpc_handler", rpc).when(kind.isin("com_method", "com_class_factory"), com).when(kind == "winrt_method", winrt)
    return F.coalesce(special, plain)


# How far in a function lies, and what its severity weighs.
REACH_WEIGHTS = {"exported": 1.0, "internal": 0.7, "deep": 0.4}
IMPACT = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.2}


def priority(score: Column, reach: Column, severity: Column) -> Column:
    """Score times the weights of reach and severity; unknown ones weigh least."""
    return score * _pick(REACH_WEIGHTS, reach, 0.4) * _pick(IMPACT, F.upper(F.trim(severity)), 0.2)


# ---------------------------------------------------------------- entries by several sources


def discovered(sources: Sequence[tuple[str, DataFrame]], key: Sequence[str] = ("module", "function_name")) -> DataFrame:
    """(key, kind, source, notes): each entry once, by the first of the sources (name, table of key and kind) that found it.

    notes name all its sources in their order.  A source may find an entry more than once.
    """
    parts = [df.select(*key, "kind", F.lit(i).alias("priority"), F.lit(name).alias("source"), F.lit(name).alias("notes")).distinct() for i, (name, df) in enumerate(sources)]
    every = reduce(DataFrame.unionByName, parts).groupBy(*key, "priority").agg(F.min("kind").alias("kind"), F.min("source").alias("source"), F.min("notes").alias("notes"))
    return R.first_by_priority(every, list(key), "priority", "notes").drop("priority")


def module_trust(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, trust) by names that a module exports (module, name) and imports (module, name); the first rule that holds counts."""
    e, i = F.lower("name"), F.lower("name")
    a = exports.groupBy("module").agg(F.bool_or(e.isin("dllgetclassobject", "dllregisterserver")).alias("com"), F.bool_or(e == "servicemain").alias("service"))
    b = imports.groupBy("module").agg(
        F.bool_or(i.startswith("rpcserverregisterif")).alias("rpc"), F.bool_or(F.contains(i, F.lit("startservicectrldispatcher"))).alias("dispatcher"), F.count_distinct(F.when(F.contains(i, F.lit("ntdeviceiocontrolfile")), i)).alias("device")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rule = F.when(yes("com"), "com_server").when(yes("rpc"), "rpc_server").when(yes("service") | yes("dispatcher"), "system_service").when(F.col("device") >= 2, "kernel_adjacent").otherwise("user_process")
    return a.join(b, "module", "full_outer").select("module", rule.alias("trust"))


def assessed(entries: DataFrame, findings: DataFrame, key: Sequence[str], score: str, least: float = 0.0) -> DataFrame:
    """Findings (key, severity, primitive, bypass, confidence) of ranked entries (key, score), with reach by the entry's score and the assessment's score.

    Entries below `least` are left out, and so are findings of none.
    """
    from_entry = entries.where(F.col(score) >= least).groupBy(*key).agg(F.max(score).alias("__reach"))
    j = R.lookup_join(findings, from_entry, list(key))
    factor = _pick(CONFIDENCE, F.upper("confidence"), CONFIDENCE["LOW"])
    total = 0.35 * F.coalesce("severity", F.lit(0.0)) + 0.25 * F.coalesce("primitive", F.lit(0.0)) + 0.25 * F.coalesce("bypass", F.lit(0.0)) + 0.15 * F.coalesce("__reach", F.lit(0.0))
    return j.withColumn("assessment", F.least(F.lit(1.0), total) * factor).drop("__reach")


def compared(counts: DataFrame, module: str, dimension: str, value: str, modules: Sequence[str]) -> DataFrame:
    """(dimension, a column per module): counts side by side; 0 where a module has none."""
    t = counts.where(F.col(module).isin(list(modules)))
    return t.groupBy(dimension).pivot(module, list(modules)).agg(F.sum(value)).fillna(0)
