"""Queries on findings of several scanners, how entries are found and reached, function indexes and name searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.columns import table
from factloom.functions import scalar
from factloom.model import parsed_functions
from factloom.operators import findings as N
from factloom.operators import indexes as X
from factloom.operators import layouts
from factloom.operators import relational as R
from factloom.operators import scoring as SC
from factloom.operators import search as S
from factloom.operators import store
from factloom.operators.modules import prefixed
from factloom.plans.facts import _DEF
from factloom.plans.graphs import _C
from factloom.session import cut, setting

BIG = "bigint"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _parsed(spark, d) -> DataFrame:
    return parsed_functions(table(spark, d, "module_functions"))


# ---------------------------------------------------------------- one schema for all scanners

_KIND = "regexp_replace(lower(source_type), '[^a-z]+', '', 'g')"
_NORMAL = f"""sev AS (SELECT *, {_KIND} AS k, CASE WHEN upper(split_part(trim(coalesce(severity, '')), ' ', 1)) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN upper(split_part(trim(coalesce(severity, '')), ' ', 1)) ELSE 'MEDIUM' END AS word FROM findings),
nf AS (SELECT coalesce(function_name, '?') AS function_name, 'taint' AS source_type, coalesce(sink_category, '') AS source_category, coalesce(sink, '?') AS sink, coalesce(sink_category, 'uncategorized_dangerous') AS sink_category, coalesce(severity, 'MEDIUM') AS severity, coalesce(score, 0.3) AS score FROM sev WHERE k = 'taint'
 UNION ALL SELECT coalesce(function_name, '?'), 'memory_corruption', coalesce(source_category, ''), coalesce(sink, source_category, ''), 'memory_unsafe', coalesce(severity, 'MEDIUM'), coalesce(score, 0.0) FROM sev WHERE k = 'memorycorruption'
 UNION ALL SELECT coalesce(function_name, '?'), 'logic_vulnerability', coalesce(source_category, ''), coalesce(source_category, ''), 'logic_unsafe', word, CASE word WHEN 'CRITICAL' THEN 0.95 WHEN 'HIGH' THEN 0.8 WHEN 'LOW' THEN 0.2 ELSE 0.5 END FROM sev WHERE k = 'logicvulnerability')"""


def _normalised(spark, d) -> DataFrame:
    f = table(spark, d, "findings").withColumn("k", F.regexp_replace(F.lower("source_type"), "[^a-z]+", ""))
    none = F.lit(None).cast("string")
    return N.normalised(
        {
            "taint": f.where("k = 'taint'"),
            "memory_corruption": f.where("k = 'memorycorruption'").select("function_name", F.col("source_category").alias("category"), F.col("sink").alias("dangerous_api"), "severity", "score"),
            "logic_vulnerability": f.where("k = 'logicvulnerability'").select(F.col("source_category").alias("vulnerability_type"), F.array("function_name").alias("affected_functions"), none.alias("entry_point"), F.col("severity").alias("severity_assessment")),
        }
    )


@query(f"WITH {_NORMAL} SELECT source_type, sink_category, severity, count(*) AS n, count(DISTINCT function_name) AS functions, count(*) FILTER (score >= 0.5 AND score <= 1) AS strong FROM nf GROUP BY 1, 2, 3")
def normalised_findings(spark, d):
    n = _normalised(spark, d)
    return n.groupBy("source_type", "sink_category", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("function_name").alias("functions"), F.count_if(F.col("score").between(0.5, 1)).alias("strong"))


@query(
    f"""WITH {_NORMAL} SELECT source_type, CASE source_type WHEN 'taint' THEN sink_category WHEN 'memory_corruption' THEN 'memory_unsafe' ELSE CASE WHEN source_category IN ('auth_bypass_missing_check', 'auth_bypass_ordering', 'missing_auth', 'auth_after_action', 'impersonation_leak', 'confused_deputy', 'error_path_priv_leak') THEN 'privilege' WHEN source_category IN ('toctou_race_condition', 'toctou_double_fetch') THEN 'memory_unsafe' ELSE 'uncategorized_dangerous' END END AS sink_category, count(*) AS n, CAST(sum(1) AS BIGINT) AS hops FROM nf GROUP BY 1, 2"""
)
def adapted_findings(spark, d):
    a = N.for_assessment(_normalised(spark, d))
    return a.groupBy("source_type", "sink_category").agg(F.count(F.lit(1)).alias("n"), F.sum("path_hops").alias("hops"))


@query(
    """WITH f AS (SELECT sink_category, CASE WHEN score >= 0 AND score <= 1 THEN score END AS s FROM findings), v AS (SELECT sink_category, s, CASE sink_category WHEN 'memory_unsafe' THEN CASE WHEN s >= 0.7 THEN 'CONFIRMED' ELSE 'LIKELY' END WHEN 'privilege' THEN CASE WHEN s >= 0.5 THEN 'LIKELY' ELSE 'FALSE_POSITIVE' END ELSE 'UNCERTAIN' END AS confidence FROM f)
SELECT coalesce(sink_category, '') AS sink_category, confidence, count(*) AS n, round(max(s * CASE confidence WHEN 'CONFIRMED' THEN 1.0 WHEN 'LIKELY' THEN 0.7 WHEN 'UNCERTAIN' THEN 0.3 ELSE 0 END), 3) AS best FROM v GROUP BY 1, 2"""
)
def verified_scores(spark, d):
    """Findings by the verifier of their category, with scores weighed by its confidence."""
    f = table(spark, d, "findings").select("sink_category", F.when((F.col("score") >= 0) & (F.col("score") <= 1) & ~F.isnan("score"), F.col("score")).alias("s"))
    strong = lambda least, yes, no: lambda t: F.when(t["s"] >= least, yes).otherwise(no)
    v = N.verified_by(f, "sink_category", {"memory_unsafe": strong(0.7, "CONFIRMED", "LIKELY"), "privilege": strong(0.5, "LIKELY", "FALSE_POSITIVE")})
    v = v.withColumn("w", SC.verified_score(F.col("s"), F.col("confidence"), F.lit(True)))
    return v.groupBy(F.coalesce("sink_category", F.lit("")).alias("sink_category"), "confidence").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("best"))


@query("""WITH f AS (SELECT upper(severity) AS v, CASE WHEN score >= 0 AND score <= 1 THEN score END AS s FROM findings) SELECT count(*) FILTER (v = 'CRITICAL') >= 2 OR count(*) FILTER (v = 'HIGH') >= 5 OR coalesce(max(s) >= 0.75, false) AS deepen FROM f""")
def deepen_scan(spark, d):
    f = table(spark, d, "findings").select("severity", F.when((F.col("score") >= 0) & (F.col("score") <= 1) & ~F.isnan("score"), F.col("score")).alias("score"))
    return SC.deepen(f, "severity", "score")


# ---------------------------------------------------------------- reach and scores

#: Flags and hops of parts stand for how functions are reached.
_R = """r AS (SELECT p_partkey AS id, CASE WHEN p_size % 9 = 1 THEN 'rpc_handler' WHEN p_size % 9 = 2 THEN 'com_method' WHEN p_size % 9 = 3 THEN 'winrt_method' WHEN p_size % 9 = 4 THEN 'transitive_rpc' WHEN p_size % 9 = 5 THEN 'transitive_com' WHEN p_size % 9 = 6 THEN 'transitive_winrt' WHEN p_size % 9 = 7 THEN 'export' WHEN p_size % 9 = 8 THEN 'entry_point' END AS kind,
 p_size % 2 = 0 AS elevates, CASE WHEN p_size % 3 = 0 THEN 'ncacn_http' WHEN p_size % 3 = 1 THEN 'ncacn_np' END AS protocol, p_size % 5 AS hops, p_size % 4 AS steps FROM part)"""


def _reached(spark, d) -> DataFrame:
    z = F.col("p_size")
    is_ = lambda k: z % 9 == k
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), N.reach_context(is_(1), is_(2), is_(3), is_(4), is_(5), is_(6), is_(7), is_(8)).alias("kind"), (z % 2 == 0).alias("elevates"),
        F.when(z % 3 == 0, "ncacn_http").when(z % 3 == 1, "ncacn_np").alias("protocol"), (z % 5).alias("hops"), (z % 4).alias("steps"),
    )


@query(f"WITH {_R} SELECT coalesce(kind, 'none') AS kind, count(*) AS n FROM r GROUP BY 1")
def reach_contexts(spark, d):
    return _reached(spark, d).groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_R}, b AS (SELECT *, CASE WHEN kind IN ('rpc_handler', 'com_method', 'winrt_method') THEN 1.0 WHEN kind LIKE 'transitive%' THEN 0.85 WHEN kind IN ('export', 'entry_point') THEN 0.75 ELSE 0.4 END AS b0 FROM r),
c AS (SELECT *, CASE WHEN elevates AND kind IN ('com_method', 'transitive_com') THEN least(b0 * 1.15, 1.0) WHEN protocol = 'ncacn_http' AND kind IN ('rpc_handler', 'transitive_rpc') THEN least(b0 * 1.10, 1.0) ELSE b0 END AS b1 FROM b)
SELECT id, round(least(1.0, b1 / CASE WHEN hops > 0 THEN sqrt(hops) ELSE 1 END / sqrt(greatest(steps, 1))), 6) AS score FROM c"""
)
def reach_scores(spark, d):
    r = _reached(spark, d)
    return r.select("id", F.round(N.reach_score(*map(F.col, ("kind", "elevates", "protocol", "hops", "steps"))), 6).alias("score"))


@query(f"WITH {_R} SELECT id, round(CASE kind WHEN 'rpc_handler' THEN 1.0 WHEN 'com_method' THEN 0.9 WHEN 'export' THEN 0.75 WHEN 'entry_point' THEN 0.8 ELSE 0.4 END / sqrt(greatest(hops, 1) + 1), 6) AS score FROM r")
def graduated_reach(spark, d):
    return _reached(spark, d).select("id", F.round(N.graduated_reach(F.col("kind"), F.col("hops")), 6).alias("score"))


@query(
    """WITH k AS (SELECT p_partkey AS id, ['rpc_handler', 'com_method', 'winrt_method', 'export_dll', 'tls_callback', 'other'][1 + p_size % 6] AS kind, CASE WHEN p_size % 4 = 0 THEN 'kernel_adjacent' ELSE 'user_process' END AS trust,
 CASE p_size % 5 WHEN 0 THEN ['ncacn_np'] WHEN 1 THEN ['ncalrpc', 'ncacn_ip_tcp'] WHEN 2 THEN ['ncalrpc'] WHEN 3 THEN [] END AS ps, CASE WHEN p_size % 7 < 3 THEN 'svc' END AS service, CASE p_size % 8 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' END AS tier, p_size % 2 = 0 AS elevates FROM part),
s AS (SELECT *, CASE kind WHEN 'rpc_handler' THEN CASE WHEN coalesce(len(ps), 0) = 0 THEN 0.9 ELSE greatest(CASE WHEN list_contains(ps, 'ncacn_ip_tcp') THEN 0.95 WHEN list_contains(ps, 'ncacn_np') THEN 0.85 WHEN service IS NOT NULL THEN 0.75 ELSE 0.6 END, CASE WHEN tier = 'critical' THEN 0.95 ELSE 0 END) END
 WHEN 'com_method' THEN CASE WHEN tier = 'critical' THEN 0.95 WHEN elevates THEN 0.9 WHEN tier = 'high' OR service IS NOT NULL THEN 0.8 WHEN tier IS NOT NULL THEN 0.75 ELSE 0.7 END WHEN 'winrt_method' THEN CASE tier WHEN 'critical' THEN 0.9 WHEN 'high' THEN 0.8 WHEN 'low' THEN 0.7 ELSE 0.65 END
 WHEN 'export_dll' THEN CASE WHEN trust = 'kernel_adjacent' THEN 0.7 ELSE 0.3 END WHEN 'tls_callback' THEN 0.6 ELSE 0.3 END AS score FROM k) SELECT id, CAST(score AS DOUBLE) AS score FROM s"""
)
def kind_scores(spark, d):
    z = F.col("p_size")
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    kind = F.get(arr("rpc_handler", "com_method", "winrt_method", "export_dll", "tls_callback", "other"), z % 6)
    ps = F.when(z % 5 == 0, arr("ncacn_np")).when(z % 5 == 1, arr("ncalrpc", "ncacn_ip_tcp")).when(z % 5 == 2, arr("ncalrpc")).when(z % 5 == 3, arr())
    tier = F.when(z % 8 == 0, "critical").when(z % 8 == 1, "high").when(z % 8 == 2, "low")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), F.when(z % 4 == 0, "kernel_adjacent").otherwise("user_process").alias("trust"), ps.alias("ps"), F.when(z % 7 < 3, "svc").alias("service"), tier.alias("tier"), (z % 2 == 0).alias("elevates"))
    return p.select("id", N.kind_score(*map(F.col, ("kind", "trust", "ps", "service", "tier", "elevates"))).alias("score"))


@query(
    """WITH p AS (SELECT l_orderkey AS id, l_linenumber AS line, l_quantity / 50 AS severity, l_discount * 10 AS primitive, l_tax * 10 AS bypass, 1.0 / l_linenumber AS reach, CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'MEDIUM' WHEN 'R' THEN 'odd' END AS c FROM lineitem)
SELECT id, line, round(least(1.0, 0.35 * severity + 0.25 * primitive + 0.25 * bypass + 0.15 * reach) * CASE upper(c) WHEN 'HIGH' THEN 0.85 WHEN 'MEDIUM' THEN 0.65 ELSE 0.4 END, 6) AS score FROM p"""
)
def assessment_scores(spark, d):
    li = table(spark, d, "lineitem")
    c = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "MEDIUM").when(F.col("l_returnflag") == "R", "odd")
    s = SC.weighted({"severity": F.col("l_quantity") / 50, "primitive": F.col("l_discount") * 10, "bypass": F.col("l_tax") * 10, "reach": F.lit(1.0) / F.col("l_linenumber")}, SC.ASSESSMENT_WEIGHTS)
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(s * SC.confidence_factor(c), 6).alias("score"))


@query(
    "WITH"
    + _DEF
    + """, q AS (SELECT module, function_id, len(dangerous) AS danger, coalesce(CAST(json_extract(loop_analysis, '$.loop_count') AS BIGINT), 0) AS loops, coalesce(list_max(CAST(json_extract(loop_analysis, '$.loops[*].cyclomatic_complexity') AS BIGINT[])), 0) AS complexity, len(strings) AS strings_, coalesce(decompiled_code, '') <> '' AS code, CASE WHEN starts_with(function_name, 'sub_') THEN 1 ELSE 0 END AS penalty FROM f)
SELECT module, function_id, CAST(greatest(0, least(10, least(danger, 3) + CASE WHEN loops >= 2 THEN 1 ELSE 0 END + CASE WHEN complexity >= 5 THEN 1 ELSE 0 END + CASE WHEN strings_ > 3 THEN 1 ELSE 0 END + CASE WHEN code THEN 1 ELSE 0 END - penalty)) AS INTEGER) AS interest FROM q"""
)
def interest_scores(spark, d):
    zero = lambda c: F.coalesce(c, F.lit(0))
    complexity = F.array_max(F.transform("loops.loops", lambda x: x["cyclomatic_complexity"]))
    s = SC.interest(F.size("dangerous"), zero(F.col("loops.loop_count")), zero(complexity), F.size("strings"), F.coalesce("decompiled_code", F.lit("")) != "", F.coalesce(F.startswith("function_name", F.lit("sub_")), F.lit(False)).cast("int"))
    return _parsed(spark, d).select("module", "function_id", s.alias("interest"))


@query("""SELECT module, function_id, interest_score AS interest, loop_count AS loops, CAST(row_number() OVER (ORDER BY interest_score DESC, loop_count DESC NULLS LAST, module, function_id, classified_at) AS INTEGER) AS place FROM classification_results WHERE interest_score BETWEEN 0 AND 10 QUALIFY place <= 30""")
def interesting_functions(spark, d):
    """The thirty most interesting records, then those with most loops."""
    c = table(spark, d, "classification_results").where(F.col("interest_score").between(0, 10))
    top = R.top(c.select("module", "function_id", F.col("interest_score").alias("interest"), F.col("loop_count").alias("loops"), "classified_at"), [F.desc("interest"), F.desc_nulls_last("loops"), F.asc_nulls_last("module"), F.asc_nulls_last("function_id"), F.asc_nulls_last("classified_at")], 30)
    return R.numbered(top, [F.desc("interest"), F.desc_nulls_last("loops"), F.asc_nulls_last("module"), F.asc_nulls_last("function_id"), F.asc_nulls_last("classified_at")], "place").drop("classified_at")


@query(
    """WITH f AS (SELECT id, CASE WHEN score >= 0 AND score <= 1 THEN score END AS s, upper(trim(severity)) AS v, CASE WHEN function_id IS NULL THEN 'deep' WHEN function_id % 2 = 0 THEN 'exported' ELSE 'internal' END AS w FROM findings)
SELECT id, round(s * CASE w WHEN 'exported' THEN 1.0 WHEN 'internal' THEN 0.7 ELSE 0.4 END * CASE v WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.5 ELSE 0.2 END, 6) AS priority FROM f WHERE s IS NOT NULL"""
)
def priorities(spark, d):
    f = table(spark, d, "findings").where("score >= 0 AND score <= 1 AND NOT isnan(score)")
    w = F.when(F.col("function_id").isNull(), "deep").when(F.col("function_id") % 2 == 0, "exported").otherwise("internal")
    return f.select("id", F.round(N.priority(F.col("score"), w, F.col("severity")), 6).alias("priority"))


_ENTRY = (
    _DEF
    + """, src AS (SELECT module, function_name, 'ipc_dispatcher' AS kind, 0 AS pr, 'names' AS source FROM f WHERE function_name = 'OnDispatch' UNION SELECT module, function_name, 'export_dll', 1, 'exports' FROM f WHERE mangled_name IS NOT NULL
 UNION SELECT module, function_name, 'com_method', 2, 'tables' FROM f WHERE vtable_contexts LIKE '[{%' UNION SELECT module, function_name, 'callback_registration', 3, 'calls' FROM f WHERE len(dangerous) > 0 UNION SELECT module, function_name, 'tcp_udp_handler', 4, 'texts' FROM f WHERE len(strings) > 2),
e AS (SELECT module, function_name, arg_min(kind, pr) AS kind, arg_min(source, pr) AS source, string_agg(source, '; ' ORDER BY pr) AS notes FROM src WHERE function_name IS NOT NULL GROUP BY 1, 2)"""
)


def _entries(spark, d) -> DataFrame:
    f = cut(_parsed(spark, d).where("function_name IS NOT NULL").select("module", "function_name", "mangled_name", F.size("dangerous").alias("dangerous"), F.size("strings").alias("strings"), F.size("vtables").alias("vtables")))
    of = lambda c, kind: f.where(c).select("module", "function_name", F.lit(kind).alias("kind"))
    return N.discovered(
        [
            ("names", of("function_name = 'OnDispatch'", "ipc_dispatcher")),
            ("exports", of("mangled_name IS NOT NULL", "export_dll")),
            ("tables", of("vtables > 0", "com_method")),
            ("calls", of("dangerous > 0", "callback_registration")),
            ("texts", of("strings > 2", "tcp_udp_handler")),
        ]
    )


@query("WITH" + _ENTRY + " SELECT module, function_name, kind, source, notes FROM e")
def discovered_entries(spark, d):
    return _entries(spark, d)


@query(
    "WITH"
    + _ENTRY
    + """, s AS (SELECT module, function_name, CASE kind WHEN 'ipc_dispatcher' THEN 0.8 WHEN 'export_dll' THEN 0.3 WHEN 'com_method' THEN 0.7 WHEN 'callback_registration' THEN 0.5 ELSE 0.85 END AS score FROM e),
x AS (SELECT id, lower(module) AS module, function_name, CASE WHEN score >= 0 AND score <= 1 THEN score END AS sv, CASE WHEN exploitability_score >= 0 AND exploitability_score <= 1 THEN exploitability_score END AS pv FROM findings)
SELECT id, CAST(floor(least(1.0, 0.35 * coalesce(sv, 0) + 0.25 * coalesce(pv, 0) + 0.25 + 0.15 * s.score) * 650 + 1e-6) AS BIGINT) AS thousandths FROM x JOIN s USING (module, function_name) WHERE s.score >= 0.5"""
)
def batch_assessment(spark, d):
    """Findings of entries that score .5 or more, assessed by entry and finding."""
    e = _entries(spark, d).withColumn("score", N.kind_score(F.col("kind"), F.lit("user_process"), F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)))
    unit = lambda c: F.when((F.col(c) >= 0) & (F.col(c) <= 1) & ~F.isnan(c), F.col(c))
    f = table(spark, d, "findings").select("id", F.lower("module").alias("module"), "function_name", unit("score").alias("severity"), unit("exploitability_score").alias("primitive"), F.lit(1.0).alias("bypass"), F.lit("medium").alias("confidence"))
    return N.assessed(e.select("module", "function_name", "score"), f, ["module", "function_name"], "score", 0.5).select("id", F.floor(F.col("assessment") * 1000 + 1e-6).alias("thousandths"))


@query(
    "WITH"
    + _DEF
    + """, x AS (SELECT module, unnest(outbound).function_name AS n FROM f), nm AS (SELECT module, CASE function_name WHEN 'OnDispatch' THEN 'DllGetClassObject' WHEN 'Invoke' THEN 'ServiceMain' ELSE function_name END AS n FROM f),
a AS (SELECT module, coalesce(bool_or(n = 'DllGetClassObject'), false) AS com, coalesce(bool_or(n = 'ServiceMain'), false) AS service FROM nm GROUP BY 1), b AS (SELECT module, coalesce(bool_or(n = 'Next'), false) AS rpc FROM x GROUP BY 1)
SELECT coalesce(a.module, b.module) AS module, CASE WHEN com THEN 'com_server' WHEN rpc THEN 'rpc_server' WHEN service THEN 'system_service' ELSE 'user_process' END AS trust FROM a FULL JOIN b ON a.module = b.module"""
)
def module_trust(spark, d):
    f = _parsed(spark, d)
    n = F.col("function_name")
    e = f.select("module", F.when(n == "OnDispatch", "DllGetClassObject").when(n == "Invoke", "ServiceMain").otherwise(n).alias("name"))
    x = f.select("module", F.explode("outbound").alias("x")).select("module", F.when(F.col("x.function_name") == "Next", "RpcServerRegisterIf2").otherwise(F.col("x.function_name")).alias("name"))
    return N.module_trust(e, x)


_TWO = "w AS (SELECT module, row_number() OVER (ORDER BY count(*) DESC, module) AS k FROM classification_results WHERE module IS NOT NULL GROUP BY 1 QUALIFY k <= 2)"


@query(f"WITH {_TWO} SELECT coalesce(primary_category, '') AS category, count(*) FILTER (module = (SELECT module FROM w WHERE k = 1)) AS a, count(*) FILTER (module = (SELECT module FROM w WHERE k = 2)) AS b FROM classification_results WHERE module IN (SELECT module FROM w) GROUP BY 1")
def module_comparison(spark, d):
    """Categories of the two modules with most records, side by side."""
    c = table(spark, d, "classification_results").where("module IS NOT NULL").groupBy("module", F.coalesce("primary_category", F.lit("")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    c = cut(c)
    two = [r["module"] for r in R.top(c.groupBy("module").agg(F.sum("n").alias("t")), [F.desc("t"), F.col("module")], 2).collect()]
    return N.compared(c, "module", "category", "n", two).toDF("category", *"ab"[: len(two)])


@query("""WITH c AS (SELECT p_partkey AS id, p_brand AS tier, p_size AS apis FROM part WHERE p_size > 5) SELECT id FROM c ORDER BY tier, apis DESC, id LIMIT 4""")
def audit_callees(spark, d):
    """The four callees to look at: by tier, then most APIs, among those with code."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("tier"), F.col("p_size").alias("apis"), (F.col("p_size") > 5).alias("has_code"))
    return SC.pick_callees(p, "tier", "apis", "id").select("id")


# ---------------------------------------------------------------- indexes of functions

_X = r"""x AS (SELECT lower(module_id) AS module, function_name AS name, function_signature AS signature, CASE WHEN starts_with(function_name, 'sub_') THEN 'runtime' WHEN contains(function_name, '::') THEN 'classes' END AS library, coalesce(decompiled_code, '') <> '' AS code, function_id,
 CASE WHEN function_id % 3 = 0 THEN [] ELSE ['f' || (function_id % 4) || '.c', 'all.c'] END AS files FROM module_functions WHERE function_name IS NOT NULL)"""


def _index(spark, d) -> DataFrame:
    n, i = F.col("function_name"), F.col("function_id")
    lib = F.when(F.startswith(n, F.lit("sub_")), "runtime").when(F.contains(n, F.lit("::")), "classes")
    files = F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("f"), i % 4, F.lit(".c")), F.lit("all.c")))
    f = table(spark, d, "module_functions").where("function_name IS NOT NULL")
    return f.select(F.lower("module_id").alias("module"), n.alias("name"), "function_id", lib.alias("library"), (F.coalesce("decompiled_code", F.lit("")) != "").alias("has_decompiled"), files.alias("files"))


@query(f"WITH {_X} SELECT coalesce(library, '(application)') AS library, count(*) AS n, count(*) FILTER (code) AS with_code FROM x GROUP BY 1")
def library_groups(spark, d):
    return X.library_groups(_index(spark, d))


@query(f"WITH {_X}, u AS (SELECT module, count(DISTINCT fl) AS files FROM (SELECT module, unnest(files) AS fl FROM x) GROUP BY 1) SELECT x.module, count(*) AS total, count(*) FILTER (library IS NULL) AS app, count(library) AS library, count(*) FILTER (code) AS decompiled, count(DISTINCT library) AS libraries, coalesce(max(u.files), 0) AS files FROM x LEFT JOIN u USING (module) GROUP BY 1")
def index_stats(spark, d):
    return X.index_stats(_index(spark, d))


@query(f"WITH {_X} SELECT module, round(count(library) / count(*), 4) AS noise FROM x GROUP BY 1")
def noise_ratio(spark, d):
    return X.noise_ratio(_index(spark, d))


@query(f"WITH {_X} SELECT 'app' AS part, count(*) FILTER (library IS NULL) AS n FROM x UNION ALL SELECT 'lib', count(library) FROM x UNION ALL SELECT 'classes', count(*) FILTER (library = 'classes') FROM x UNION ALL SELECT 'all', count(*) FROM x")
def library_filters(spark, d):
    i = _index(spark, d)
    lib = F.col("library")
    one = i.agg(F.count_if(lib.isNull()).alias("app"), F.count_if(lib.isNotNull()).alias("lib"), F.count_if(lib == "classes").alias("classes"), F.count(F.lit(1)).alias("all"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("n")) for c in one.columns])))


@query(f"WITH {_X} SELECT module, name, function_id FROM x WHERE contains(lower(name), 'parse') AND library IS NULL UNION ALL SELECT module, name, function_id FROM x WHERE regexp_matches(name, '(?i)load[a-z]+') AND library = 'classes'")
def index_search(spark, d):
    """Substring among the application's functions, and a regular expression among those of one library."""
    i = _index(spark, d)
    a = X.search_index(i, "Parse", app_only=True).unionByName(X.search_index(i, "load[a-z]+", "regex", library="Classes"))
    return a.select("module", "name", "function_id")


@query("SELECT lower(module_id) AS module, function_id, CASE WHEN contains(lower(function_name), 'session') THEN 'name' ELSE 'signature' END AS how FROM module_functions WHERE contains(lower(function_name), 'session') OR contains(lower(function_signature), 'session')")
def name_or_signature(spark, d):
    f = table(spark, d, "module_functions").select(F.lower("module_id").alias("module"), "function_id", "function_name", "function_signature")
    return X.name_or_signature(f, "Session")


@query("SELECT lower(module_id) AS module, function_id FROM module_functions WHERE len(list_filter(CASE WHEN string_literals LIKE '[%' THEN CAST(string_literals::JSON AS VARCHAR[]) ELSE [] END, lambda s: contains(lower(s), 'token'))) > 0")
def prefiltered_strings(spark, d):
    """A containment test on a JSON list: first on its text, then on the values."""
    f = X.prefiltered(table(spark, d, "module_functions"), "string_literals", "token")
    return parsed_functions(f).where(F.exists("strings", lambda s: R.contains_text(s, "token"))).select("module", "function_id")


@query(
    """WITH w AS (SELECT analysis_db_path AS wanted, file_name, status FROM analyzed_files WHERE analysis_db_path IS NOT NULL UNION ALL SELECT upper(file_path), file_name, status FROM analyzed_files WHERE file_path IS NOT NULL), s AS (SELECT regexp_replace(lower(file_name), '\\.[a-z]+$', '') AS k, count(*) AS c FROM analyzed_files GROUP BY 1)
SELECT wanted, CASE WHEN ends_with(wanted, '.db') AND s.c > 1 THEN NULL ELSE file_name END AS module, CASE WHEN ends_with(wanted, '.db') AND s.c > 1 THEN 'ambiguous' WHEN coalesce(status, '') <> 'COMPLETE' THEN 'incomplete' WHEN ends_with(wanted, '.db') THEN 'normal' ELSE 'exact' END AS how FROM w JOIN s ON s.k = regexp_replace(lower(file_name), '\\.[a-z]+$', '')"""
)
def module_resolution(spark, d):
    """Modules by the names of their index files and by paths in any case."""
    r = table(spark, d, "analyzed_files")
    w = r.where("analysis_db_path IS NOT NULL").select(F.col("analysis_db_path").alias("wanted")).union(r.where("file_path IS NOT NULL").select(F.upper("file_path")))
    return X.resolve_modules(w, r.select("file_name", "status"))


@query(
    f"""WITH {_C}, q AS (SELECT *, CASE WHEN lower(text) = 'index' THEN 1.0 WHEN strpos(lower(text), 'index') = 1 THEN 0.85 WHEN strpos(lower(text), 'index') > 1 AND (substr(text, strpos(lower(text), 'index') - 1, 1) = '_' OR regexp_matches(substr(text, strpos(lower(text), 'index') - 1, 2), '^[a-z][A-Z]$')) THEN 0.75 WHEN strpos(lower(text), 'index') > 1 THEN 0.6 END AS quality FROM t),
h AS (SELECT *, least(1.0, round(quality * 0.5 + 0.15 + CASE WHEN has_code THEN 0.1 ELSE 0 END + CASE WHEN has_danger THEN 0.05 ELSE 0 END, 4)) AS score FROM q WHERE quality IS NOT NULL), b AS (SELECT module, id, dim, pos, min(name) AS name, max(score) AS score FROM h GROUP BY 1, 2, 3, 4),
l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY dim ORDER BY score DESC, module, id) <= 25), g AS (SELECT module, id, min(name) AS name, max(score) AS best, arg_max(dim, (score, -pos)) AS dim, count(*) AS dims FROM l GROUP BY 1, 2)
SELECT module, id, name, CAST(least(1.0, round(best + CASE WHEN dims > 1 THEN least(0.15, 0.05 * dims) ELSE 0 END, 4)) AS DOUBLE) AS score, dim, dims FROM g"""
)
def search_best_per_dimension(spark, d):
    """The best twenty-five matches of each dimension, ranked before the limit."""
    return S.search(S.candidates(_parsed(spark, d)), S.substring_quality(F.col("text"), "index"), per_dim=25)


# ---------------------------------------------------------------- names, signatures and settings


@query("WITH" + _DEF + ", n AS (SELECT DISTINCT unnest(outbound).function_name AS api FROM f) SELECT api, regexp_replace(api, '^(__imp_|_imp_|j_|cs:)', '') AS name FROM n WHERE api IS NOT NULL")
def stripped_imports(spark, d):
    n = _parsed(spark, d).select(F.explode(F.transform("outbound", lambda x: x["function_name"])).alias("api")).where("api IS NOT NULL").distinct()
    return n.select("api", scalar.strip_import(F.col("api")).alias("name"))


@query("SELECT lower(module_id) AS module, function_id, CAST(coalesce(list_max(list_transform(regexp_extract_all(decompiled_code, '\\ba(\\d{1,3})\\b', 1), lambda x: CAST(x AS INTEGER))), 0) AS INTEGER) AS n FROM module_functions WHERE decompiled_code IS NOT NULL")
def inferred_parameters(spark, d):
    return table(spark, d, "module_functions").where("decompiled_code IS NOT NULL").select(F.lower("module_id").alias("module"), "function_id", scalar.inferred_parameters(F.col("decompiled_code")).alias("n"))


@query("SELECT lower(module_id) AS module, function_id, trim(p) AS parameter FROM (SELECT module_id, function_id, unnest(string_split(regexp_extract(function_signature, '\\((.*)\\)', 1), ',')) AS p FROM module_functions WHERE function_signature IS NOT NULL AND regexp_full_match(function_signature, '[^()<>]*\\([^()<>]*\\)')) WHERE trim(p) NOT IN ('', 'void')")
def signature_parameters(spark, d):
    """Types and names of parameters, of signatures without nested brackets."""
    f = table(spark, d, "module_functions").where(F.col("function_signature").rlike(r"^[^()<>]*\([^()<>]*\)$"))
    p = f.select(F.lower("module_id").alias("module"), "function_id", F.explode(scalar.signature_parameters(F.col("function_signature"))).alias("p"))
    # a name's stars stand at the type; written again as they were: 'void *a1'
    text = F.when(F.col("p.name").isNull(), F.col("p.type")).otherwise(F.concat("p.type", F.when(F.col("p.type").rlike(r"[*&]$"), "").otherwise(" "), F.col("p.name")))
    return p.select("module", "function_id", text.alias("parameter"))


@query(r"""WITH i AS (SELECT lower(module_id) AS module, function_id, coalesce(regexp_extract(function_signature, '\((.*)\)', 1), '') AS p FROM module_functions) SELECT module, count(*) FILTER (regexp_matches(p, '(?i)\b(void|char|byte|uint8_t|_BYTE)\s*\*')) AS buffer, count(*) FILTER (regexp_matches(p, '(?i)\b(size_t|cb\w*|cch\w*|len\w*|\w*size)\b')) AS length, count(*) FILTER (regexp_matches(p, '(?i)\b(HANDLE|SOCKET|HKEY|FILE\s*\*)')) AS handle FROM i GROUP BY 1""")
def parameter_surfaces(spark, d):
    s = table(spark, d, "module_functions").select(F.lower("module_id").alias("module"), scalar.parameter_surface(F.col("function_signature")).alias("s"))
    return s.groupBy("module").agg(*[F.count_if(F.col(f"s.{k}")).alias(k) for k in ("buffer", "length", "handle")])


@query("SELECT lower(module_id) AS module, function_id, unnest(list_distinct(regexp_extract_all(decompiled_code, '(\\w+)\\s*=\\s*(?:\\([^()]*\\)\\s*)?Next\\s*\\(', 1))) AS target FROM module_functions WHERE decompiled_code IS NOT NULL")
def assigned_results(spark, d):
    """Names that are assigned what a callee returns."""
    f = table(spark, d, "module_functions").where("decompiled_code IS NOT NULL")
    return f.select(F.lower("module_id").alias("module"), "function_id", F.explode(scalar.assigned_from(F.col("decompiled_code"), "Next")).alias("target"))


@query(r"""SELECT id, CASE WHEN length(summary) > 20 THEN substr(summary, 1, 17) || '...' ELSE summary END AS short, CASE WHEN n = '' THEN 'item' ELSE n END AS safe FROM (SELECT id, summary, coalesce(substr(regexp_replace(regexp_replace(summary, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 80), '') AS n FROM findings)""")
def short_texts(spark, d):
    return table(spark, d, "findings").select("id", scalar.truncated(F.col("summary"), 20).alias("short"), scalar.safe_name(F.col("summary")).alias("safe"))


@query("SELECT 'cutoff' AS name, CAST(0.75 AS DOUBLE) AS value, (SELECT count(*) FROM findings WHERE score >= 0.75 AND score <= 1) AS n")
def setting_lookup(spark, d):
    """A setting by dotted path, from the session or its default, and what it selects."""
    least = float(setting(spark, "assess.cutoff", "0.75"))
    n = table(spark, d, "findings").where((F.col("score") >= least) & (F.col("score") <= 1) & ~F.isnan("score")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit("cutoff").alias("name"), F.lit(least).alias("value"), "n")


@query()
def struct_headers(spark, d):
    """A header text for each structure that code accesses."""
    f = layouts.fields(layouts.accesses(_parsed(spark, d)))
    named = f.select(F.concat_ws("_", F.regexp_replace("module", r"\W", "_"), "base").alias("name"), "byte_offset", "size")
    return layouts.headers(named, "name")


@query("""WITH a AS (SELECT file_name, md5_hash AS m, lower(file_extension) AS e FROM analyzed_files), b AS (SELECT file_name, CASE WHEN length(file_name) % 5 = 0 THEN NULL ELSE md5_hash END AS m, file_extension || ' ' AS e FROM analyzed_files WHERE length(file_name) % 7 <> 0)
SELECT coalesce(a.file_name, b.file_name) AS file_name, field, CASE WHEN l IS NULL AND r IS NULL THEN 'ok' WHEN l IS NULL OR r IS NULL THEN 'missing' WHEN trim(l) = trim(r) THEN 'ok' ELSE 'differs' END AS verdict FROM a FULL JOIN b ON a.file_name = b.file_name, LATERAL (VALUES ('m', a.m, b.m), ('e', a.e, b.e)) AS v(field, l, r)""")
def field_compare(spark, d):
    """Two records of each file, field by field."""
    f = table(spark, d, "analyzed_files")
    a = f.select("file_name", F.col("md5_hash").alias("m"), F.lower("file_extension").alias("e"))
    n = F.length("file_name")
    b = f.where(n % 7 != 0).select("file_name", F.when(n % 5 != 0, F.col("md5_hash")).alias("m"), F.concat("file_extension", F.lit(" ")).alias("e"))
    return R.field_compare(a, b, "file_name", ["m", "e"])


@query("""SELECT id, source_type AS scanner, CASE WHEN regexp_replace(lower(source_type), '[^a-z]+', '', 'g') = 'taint' THEN score END AS score FROM findings""")
def merged_outputs(spark, d):
    """Outputs of two scanners in one table; columns that one lacks are null."""
    f = table(spark, d, "findings").withColumn("k", F.coalesce(F.regexp_replace(F.lower("source_type"), "[^a-z]+", "") == "taint", F.lit(False)))
    a, b = f.where("k").select("id", F.col("source_type").alias("scanner"), "score"), f.where("NOT k").select("id", F.col("source_type").alias("scanner"))
    return store.merged([a, b])


@query("WITH s(x) AS (VALUES (''), ('A'), ('W'), ('Ex'), ('ExA'), ('ExW')), t AS (SELECT DISTINCT term || x AS name FROM taxonomy, s WHERE kind = 'sink') SELECT name, name IN (SELECT term FROM taxonomy WHERE kind = 'sink') AS listed FROM t")
def expanded_names(spark, d):
    """The listed names with the usual suffixes."""
    t = table(spark, d, "taxonomy").where("kind = 'sink'").select("term")
    every = t.select(F.explode(prefixed(F.col("term"))).alias("name")).distinct()
    return every.join(t.select(F.col("term").alias("name"), F.lit(True).alias("l")).distinct(), "name", "left").select("name", F.coalesce("l", F.lit(False)).alias("listed"))


@query("SELECT lower(module_id) AS module, function_id FROM module_functions WHERE contains(function_name, '_') AND contains(lower(function_name), 'sub_1')")
def escaped_like(spark, d):
    """A caller's text in a LIKE pattern, its wildcards as plain characters."""
    return table(spark, d, "module_functions").where(R.like_text(F.col("function_name"), f"%{R.escape_like('SUB_1')}%")).select(F.lower("module_id").alias("module"), "function_id")


@query("SELECT lower(module_id) AS module, count(*) AS n FROM module_functions WHERE function_id >= 5 GROUP BY 1")
def guarded_select(spark, d):
    """A caller's statement that was checked to only read, with a parameter, over a named table."""
    return R.safe_select(spark, "SELECT lower(module_id) AS module, count(*) AS n FROM {functions} WHERE function_id >= :least GROUP BY 1", {"least": 5}, functions=table(spark, d, "module_functions"))


@query("""SELECT floor((row_number() OVER (ORDER BY lower(module_id), function_id) - 1) / 100)::BIGINT AS batch, lower(module_id) AS module, function_id FROM module_functions""")
def scan_batches(spark, d):
    """The scan in batches of a hundred functions, by their order."""
    f = table(spark, d, "module_functions").select(F.lower("module_id").alias("module"), "function_id")
    return R.batched(f, [F.col("module"), F.col("function_id")], 100, "batch").select("batch", "module", "function_id")


@query("""WITH n AS (SELECT count(*) AS c FROM module_functions), k AS (SELECT greatest(least(40, greatest(10, 5 + c // 100)), least(40, (60 + 1) // 2)) AS k FROM n) SELECT id FROM findings, k WHERE score >= 0 AND score <= 1 QUALIFY row_number() OVER (ORDER BY score DESC, id) <= k""")
def adaptive_report(spark, d):
    """The first findings, as many as the number of functions and sixty entries ask for."""
    k = R.adaptive_limit(table(spark, d, "module_functions").count(), 10, 40, entries=60)
    f = table(spark, d, "findings").where("score >= 0 AND score <= 1 AND NOT isnan(score)").select("id", "score")
    return R.top(f, [F.desc("score"), F.col("id")], k).select("id")
