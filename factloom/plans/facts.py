"""Queries over functions and the module registry, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.columns import table
from factloom.functions import scalar
from factloom.model import has_value, parsed_functions, xref_name
from factloom.operators import graph, layouts, measures, modules
from factloom.operators import relational as R

BIG = "bigint"


def fn(spark: SparkSession, d: str) -> DataFrame:
    return parsed_functions(table(spark, d, "module_functions"))


def registry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "analyzed_files")


QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The functions table with parsed lists, as the SQL sees it.
_DEF = """
f AS (SELECT lower(module_id) AS module, *,
 CASE WHEN dangerous_api_calls LIKE '[%' THEN CAST(dangerous_api_calls::JSON AS VARCHAR[]) ELSE [] END AS dangerous,
 CASE WHEN string_literals LIKE '[%' THEN CAST(string_literals::JSON AS VARCHAR[]) ELSE [] END AS strings,
 CASE WHEN simple_outbound_xrefs LIKE '[%' THEN CAST(simple_outbound_xrefs::JSON AS STRUCT(function_name VARCHAR, function_id BIGINT, module_name VARCHAR, function_type INT, xref_type VARCHAR, extraction_type VARCHAR)[]) ELSE [] END AS outbound,
 CASE WHEN global_var_accesses LIKE '[%' THEN CAST(global_var_accesses::JSON AS STRUCT(address VARCHAR, name VARCHAR, access_type VARCHAR)[]) ELSE [] END AS globals
 FROM module_functions)
"""


@query("SELECT lower(module_id) AS module, function_id, function_name FROM module_functions ORDER BY module, function_id LIMIT 50 OFFSET 20")
def scan_page(spark, d):
    return fn(spark, d).select("module", "function_id", "function_name").orderBy("module", "function_id").offset(20).limit(50)


@query("SELECT lower(module_id) AS module, function_id FROM module_functions WHERE simple_outbound_xrefs IS NOT NULL AND simple_outbound_xrefs <> '' AND simple_outbound_xrefs NOT LIKE '[]%' AND simple_outbound_xrefs NOT LIKE 'null%'")
def outbound_only(spark, d):
    f = table(spark, d, "module_functions")
    return f.where(has_value("simple_outbound_xrefs")).select(F.lower("module_id").alias("module"), "function_id")


@query("SELECT lower(module_id) AS module, function_id, function_name, function_signature, length(decompiled_code) AS code_length FROM module_functions WHERE coalesce(decompiled_code, '') <> ''")
def slim_functions(spark, d):
    return fn(spark, d).where("coalesce(decompiled_code, '') <> ''").select("module", "function_id", "function_name", "function_signature", F.length("decompiled_code").cast(BIG).alias("code_length"))


@query("SELECT DISTINCT function_name FROM module_functions WHERE function_name IS NOT NULL")
def function_name_list(spark, d):
    return table(spark, d, "module_functions").where("function_name IS NOT NULL").select("function_name").distinct()


@query("SELECT sha256_hash FROM analyzed_files")
def registry_field(spark, d):
    return R.one_column(registry(spark, d), "sha256_hash")


@query("SELECT lower(module_id) AS module, function_name FROM module_functions WHERE function_id = 3")
def point_lookup(spark, d):
    return fn(spark, d).where(F.col("function_id") == 3).select("module", "function_name")


@query("SELECT lower(module_id) AS module, function_id FROM module_functions WHERE lower(function_name) = 'ondispatch'")
def name_any_case(spark, d):
    return fn(spark, d).where(R.equals_text(F.col("function_name"), "OnDispatch")).select("module", "function_id")


@query("SELECT lower(module_id) AS module, function_id FROM module_functions WHERE function_signature ILIKE 'int %(void *a1%'")
def signature_like(spark, d):
    return fn(spark, d).where(R.like_text(F.col("function_signature"), "int %(void *a1%")).select("module", "function_id")


@query(
    "WITH"
    + _DEF
    + """SELECT module, function_id, function_name FROM f WHERE lower(function_name) LIKE '%parse%' AND coalesce(decompiled_code, '') <> '' AND len(dangerous) > 0
 ORDER BY function_name, module, function_id LIMIT 40 OFFSET 2"""
)
def multi_filter_page(spark, d):
    return R.function_filter(fn(spark, d), name="parse", has_code=True, has_dangerous=True, order_by="function_name", limit=40, offset=2).select("module", "function_id", "function_name")


@query("WITH" + _DEF + "SELECT module, function_id FROM f WHERE len(list_filter(dangerous, lambda x: contains(lower(x), 'token'))) > 0")
def json_list_contains(spark, d):
    return fn(spark, d).where(F.exists("dangerous", lambda x: R.contains_text(x, "token"))).select("module", "function_id")


@query("SELECT lower(m.module_id) AS module, m.function_id, m.function_name FROM module_functions m WHERE EXISTS (SELECT 1 FROM classification_results c WHERE lower(c.module) = lower(m.module_id) AND c.function_id = m.function_id AND c.interest_score BETWEEN 8 AND 10)")
def in_list_semi(spark, d):
    keys = table(spark, d, "classification_results").where(F.col("interest_score").between(8, 10)).select(F.lower("module").alias("module"), "function_id")
    return R.in_keys(fn(spark, d), keys, ["module", "function_id"]).select("module", "function_id", "function_name")


@query("SELECT lower(m.module_id) AS module, m.function_id FROM module_functions m WHERE NOT EXISTS (SELECT 1 FROM classification_results c WHERE lower(c.module) = lower(m.module_id) AND c.function_id = m.function_id)")
def unclassified_anti(spark, d):
    keys = table(spark, d, "classification_results").select(F.lower("module").alias("module"), "function_id")
    return R.not_in_keys(fn(spark, d), keys, ["module", "function_id"]).select("module", "function_id")


@query("SELECT lower(module_id) AS module, function_id, function_name FROM module_functions WHERE function_id BETWEEN 5 AND 9")
def id_range(spark, d):
    return fn(spark, d).where(F.col("function_id").between(5, 9)).select("module", "function_id", "function_name")


@query(
    """WITH w(wanted) AS (VALUES ('ondispatch'), ('NEXT'), ('NoSuchName'))
SELECT wanted, count(function_id) AS n, count(DISTINCT lower(module_id)) AS modules FROM w LEFT JOIN module_functions ON lower(function_name) = lower(wanted) GROUP BY 1"""
)
def names_left_lookup(spark, d):
    w = spark.createDataFrame([("ondispatch",), ("NEXT",), ("NoSuchName",)], "wanted string")
    j = F.broadcast(w).join(fn(spark, d).select("module", "function_id", "function_name"), F.lower("function_name") == F.lower("wanted"), "right").where("wanted IS NOT NULL")
    counts = j.groupBy("wanted").agg(F.count("function_id").alias("n"), F.count_distinct("module").alias("modules"))
    return w.join(F.broadcast(counts), "wanted", "left").fillna(0)


@query("SELECT file_name, md5_hash FROM analyzed_files WHERE status = 'COMPLETE' AND file_extension = '.dll'")
def registry_filters(spark, d):
    return R.by_filters(registry(spark, d), {"status": "COMPLETE", "file_extension": ".dll"}).select("file_name", "md5_hash")


@query("SELECT status, count(*) AS n FROM analyzed_files GROUP BY 1")
def group_status_count(spark, d):
    return registry(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT status FROM analyzed_files")
def distinct_statuses(spark, d):
    return registry(spark, d).select("status").distinct()


@query("SELECT file_name, json_extract_string(analysis_flags, '$.thunk_depth') AS depth, json_extract_string(analysis_flags, '$.analyze_loops') AS loops FROM analyzed_files")
def json_flag_paths(spark, d):
    v = F.try_parse_json("analysis_flags")
    return registry(spark, d).select("file_name", F.try_variant_get(v, "$.thunk_depth", "string").alias("depth"), F.try_variant_get(v, "$.analyze_loops", "string").alias("loops"))


@query(
    """SELECT file_name, CAST(epoch(CAST(analysis_completion_timestamp AS TIMESTAMPTZ)) - epoch(CAST(analysis_start_timestamp AS TIMESTAMPTZ)) AS BIGINT) AS seconds
 FROM analyzed_files WHERE analysis_completion_timestamp IS NOT NULL AND analysis_start_timestamp IS NOT NULL"""
)
def analysis_seconds(spark, d):
    t = lambda c: F.col(c).try_cast("timestamp")
    r = registry(spark, d).where("analysis_completion_timestamp IS NOT NULL AND analysis_start_timestamp IS NOT NULL")
    micros = F.unix_micros(t("analysis_completion_timestamp")) - F.unix_micros(t("analysis_start_timestamp"))
    return r.select("file_name", F.round(micros / 1e6).cast(BIG).alias("seconds"))


@query(
    "WITH"
    + _DEF
    + """SELECT count(*) AS total, count(*) FILTER (coalesce(decompiled_code, '') <> '') AS with_code, count(*) FILTER (len(dangerous) > 0) AS with_dangerous,
 count(*) FILTER (len(strings) > 0) AS with_strings, count(*) FILTER (vtable_contexts IS NOT NULL AND vtable_contexts NOT LIKE 'null%' AND vtable_contexts <> '') AS with_vtable_text FROM f"""
)
def global_conditional_stats(spark, d):
    base = fn(spark, d)
    raw = table(spark, d, "module_functions").agg(F.count_if(has_value("vtable_contexts", lists=False)).alias("with_vtable_text"), F.lit(1).alias("k"))
    one = R.conditional_counts(base, with_code=F.coalesce("decompiled_code", F.lit("")) != "", with_dangerous=F.size("dangerous") > 0, with_strings=F.size("strings") > 0)
    return one.withColumn("k", F.lit(1)).join(raw, "k").drop("k")


@query("WITH" + _DEF + "SELECT module, function_id, len(dangerous) AS n FROM f WHERE len(dangerous) > 0 ORDER BY n DESC, module, function_id LIMIT 25")
def dangerous_ranking(spark, d):
    f = fn(spark, d).select("module", "function_id", F.size("dangerous").cast(BIG).alias("n")).where("n > 0")
    return R.top(f, [F.desc("n"), F.col("module"), F.col("function_id")], 25)


@query(
    """SELECT lower(module_id) AS module, function_id, CAST(json_extract(loop_analysis, '$.loop_count') AS BIGINT) AS loops,
 list_max(CAST(json_extract(loop_analysis, '$.loops[*].nesting_level') AS BIGINT[])) AS nesting, list_max(CAST(json_extract(loop_analysis, '$.loops[*].cyclomatic_complexity') AS BIGINT[])) AS complexity
 FROM module_functions WHERE CAST(json_extract(loop_analysis, '$.loop_count') AS BIGINT) > 0"""
)
def loop_metrics(spark, d):
    return measures.loop_metrics(fn(spark, d))


@query("WITH" + _DEF + "SELECT module, function_id, len(outbound) AS hub FROM f ORDER BY hub DESC, module, function_id LIMIT 30")
def hub_scores(spark, d):
    f = fn(spark, d).select("module", "function_id", (F.size("outbound") + F.size("inbound")).cast(BIG).alias("hub"))
    return R.top(f, [F.desc("hub"), F.col("module"), F.col("function_id")], 30)


@query(
    "WITH"
    + _DEF
    + """, g AS (SELECT module, function_id, unnest(globals) AS g FROM f)
SELECT module, function_id, count(*) FILTER (lower(g.access_type) = 'read') AS reads, count(*) FILTER (lower(g.access_type) = 'write') AS writes, array_to_string(list_sort(list_distinct(list(g.name)))[1:10], ',') AS names FROM g GROUP BY 1, 2"""
)
def global_state(spark, d):
    return measures.global_state(fn(spark, d))


@query(
    "WITH"
    + _DEF
    + """, g AS (SELECT module, function_id, unnest(globals) AS g FROM f)
SELECT g.name AS name, count(DISTINCT (module, function_id)) FILTER (lower(g.access_type) = 'read') AS readers, count(DISTINCT (module, function_id)) FILTER (lower(g.access_type) = 'write') AS writers FROM g GROUP BY 1"""
)
def shared_state(spark, d):
    return measures.shared_state(fn(spark, d))


@query(
    """WITH s AS (SELECT CASE WHEN n < 10 THEN 'tiny' WHEN n < 50 THEN 'small' WHEN n < 200 THEN 'medium' WHEN n < 500 THEN 'large' ELSE 'huge' END AS bucket FROM (SELECT len(string_split(assembly_code, chr(10))) AS n FROM module_functions WHERE assembly_code IS NOT NULL))
SELECT bucket, count(*) AS n FROM s GROUP BY 1"""
)
def size_buckets(spark, d):
    n = F.size(F.split("assembly_code", "\n"))
    f = fn(spark, d).where("assembly_code IS NOT NULL").select(R.bucketed(n, (10, 50, 200, 500), ("tiny", "small", "medium", "large", "huge")).alias("bucket"))
    return f.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH"
    + _DEF
    + """, e AS (SELECT module, function_id, unnest(strings) AS s FROM f)
SELECT trim(s) AS string, count(*) AS refs, count(DISTINCT (module, function_id)) AS owners FROM e WHERE length(s) <= 500 AND trim(s) <> '' GROUP BY 1"""
)
def string_inventory(spark, d):
    return R.string_inventory(fn(spark, d), "strings", ["module", "function_id"])


@query(
    """SELECT CASE WHEN analysis_errors IS NULL THEN 'none' WHEN analysis_errors LIKE '[%' THEN json_extract_string(analysis_errors, '$[0].stage') ELSE json_extract_string(analysis_errors, '$.stage') END AS stage, count(*) AS n FROM module_functions GROUP BY 1"""
)
def error_stages(spark, d):
    return table(spark, d, "module_functions").groupBy(measures.error_stage(F.col("analysis_errors")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT lower(module_id) AS module, count(*) AS functions, round(100.0 * count(*) FILTER (coalesce(decompiled_code, '') <> '') / count(*), 1) AS coverage FROM module_functions GROUP BY 1"""
)
def code_coverage(spark, d):
    f = fn(spark, d).groupBy("module").agg(F.count(F.lit(1)).alias("functions"), F.count_if(F.coalesce("decompiled_code", F.lit("")) != "").alias("c"))
    return f.select("module", "functions", F.round(F.lit(100.0) * F.col("c") / F.col("functions"), 1).alias("coverage"))


@query(
    "WITH"
    + _DEF
    + """, v AS (SELECT module, function_id, unnest(CAST(json_extract(vtable_contexts, '$[*].reconstructed_classes[*]') AS VARCHAR[])) AS c FROM f WHERE vtable_contexts LIKE '[{%')
SELECT regexp_extract(c, '(?:class|struct)\\s+([\\w:]+)', 1) AS class, count(*) AS refs, count(DISTINCT (module, function_id)) AS functions FROM v GROUP BY 1"""
)
def vtable_classes(spark, d):
    v = fn(spark, d).select("module", "function_id", F.explode("vtables").alias("v")).select("module", "function_id", F.explode("v.reconstructed_classes").alias("c"))
    return v.groupBy(scalar.class_of(F.col("c")).alias("class")).agg(F.count(F.lit(1)).alias("refs"), F.count_distinct(F.struct("module", "function_id")).alias("functions"))


@query("WITH" + _DEF + ", x AS (SELECT module, unnest(outbound) AS x FROM f) SELECT module, lower(x.module_name) AS target, count(*) AS calls, count(DISTINCT x.function_name) AS names FROM x WHERE coalesce(x.module_name, '') <> '' AND lower(x.module_name) <> module GROUP BY 1, 2")
def dependency_edges(spark, d):
    return measures.dependency_edges(fn(spark, d))


@query(
    "WITH"
    + _DEF
    + """, e AS (SELECT DISTINCT module, lower(x.module_name) AS target FROM (SELECT module, unnest(outbound) AS x FROM f) WHERE coalesce(x.module_name, '') <> '' AND lower(x.module_name) <> module)
SELECT coalesce(o.module, i.module) AS module, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in FROM (SELECT module, count(*) AS fan_out FROM e GROUP BY 1) o FULL JOIN (SELECT target AS module, count(*) AS fan_in FROM e GROUP BY 1) i ON o.module = i.module"""
)
def dependency_overview(spark, d):
    return measures.fan(measures.dependency_edges(fn(spark, d)))


@query(
    "WITH"
    + _DEF
    + """, e AS (SELECT module, x.function_name AS api FROM (SELECT module, unnest(outbound) AS x FROM f))
SELECT api, count(DISTINCT module) AS modules, count(*) AS calls, array_to_string(list_sort(list_distinct(list(module)))[1:5], ',') AS sample FROM e GROUP BY 1"""
)
def who_imports(spark, d):
    e = fn(spark, d).select("module", F.explode("outbound").alias("x")).select("module", xref_name(F.col("x")).alias("api"))
    g = e.groupBy("api").agg(F.count_distinct("module").alias("modules"), F.count(F.lit(1)).alias("calls"), F.array_sort(F.collect_set("module")).alias("m"))
    return g.select("api", "modules", "calls", F.array_join(F.slice("m", 1, 5), ",").alias("sample"))


@query(
    "WITH"
    + _DEF
    + """SELECT x.xref_type AS kind, count(*) AS n, count(DISTINCT x.function_name) AS names FROM (SELECT unnest(outbound) AS x FROM f) GROUP BY 1"""
)
def xref_mix(spark, d):
    return measures.xref_mix(fn(spark, d))


@query(
    "WITH"
    + _DEF
    + """SELECT f.module, f.function_id, t.sink_category AS category, count(*) AS n FROM (SELECT module, function_id, unnest(dangerous) AS api FROM f) f JOIN taxonomy t ON t.kind = 'sink' AND t.term = f.api GROUP BY ALL"""
)
def sink_density(spark, d):
    api = fn(spark, d).select("module", "function_id", F.explode("dangerous").alias("term"))
    t = table(spark, d, "taxonomy").where("kind = 'sink'").select("term", F.col("sink_category").alias("category"))
    return R.lookup_join(api, t, ["term"]).groupBy("module", "function_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH"
    + _DEF
    + """, t AS (SELECT module, function_id, CASE WHEN lower(function_name) LIKE 'sub\\_%' ESCAPE '\\' THEN 'unnamed' WHEN function_name LIKE '%::%' THEN 'method' WHEN function_name LIKE '~%' THEN 'destructor' ELSE 'function' END AS kind FROM f)
SELECT module, kind, count(*) AS n FROM t GROUP BY 1, 2"""
)
def name_kinds(spark, d):
    return fn(spark, d).groupBy("module", scalar.name_kind(F.col("function_name")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(module_id) AS module, function_id, len(string_split(regexp_extract(function_signature, '\\((.*)\\)', 1), ',')) AS params FROM module_functions WHERE regexp_extract(function_signature, '\\((.*)\\)', 1) <> ''")
def parameter_counts(spark, d):
    return fn(spark, d).select("module", "function_id", scalar.parameter_count(F.col("function_signature")).alias("params")).where("params > 0")


@query(
    """WITH c AS (SELECT lower(module_id) AS module, function_id, list_distinct(regexp_extract_all(substr(decompiled_code, strpos(decompiled_code, '{')), '([A-Za-z_~][\\w:~]*)\\s*\\(', 1)) AS calls FROM module_functions WHERE decompiled_code IS NOT NULL),
e AS (SELECT module, function_id, unnest(list_filter(calls, lambda x: x NOT IN ('if', 'for', 'while', 'switch', 'return', 'sizeof'))) AS callee FROM c)
SELECT callee, count(*) AS callers FROM e GROUP BY 1"""
)
def calls_in_code(spark, d):
    e = fn(spark, d).where("decompiled_code IS NOT NULL").select("module", "function_id", F.explode(scalar.calls_in(F.col("decompiled_code"))).alias("callee"))
    return e.groupBy("callee").agg(F.count(F.lit(1)).alias("callers"))


@query(
    """SELECT module_, op, count(*) AS n FROM (SELECT lower(module_id) AS module_, unnest(list_transform(string_split(assembly_code, chr(10)), lambda x: split_part(trim(x), ' ', 1))) AS op FROM module_functions) WHERE op <> '' GROUP BY 1, 2"""
)
def opcode_mix(spark, d):
    ops = fn(spark, d).select(F.col("module").alias("module_"), F.explode(F.transform(F.split("assembly_code", "\n"), lambda x: F.split_part(F.trim(x), F.lit(" "), F.lit(1)))).alias("op"))
    return ops.where("op <> ''").groupBy("module_", "op").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(module_id) AS module, CAST(json_extract(stack_frame, '$.has_canary') AS BOOLEAN) AS canary, count(*) AS n, max(CAST(json_extract(stack_frame, '$.local_vars_size') AS BIGINT)) AS largest FROM module_functions WHERE stack_frame IS NOT NULL GROUP BY 1, 2")
def stack_frames(spark, d):
    return fn(spark, d).where("frame IS NOT NULL").groupBy("module", F.col("frame.has_canary").alias("canary")).agg(F.count(F.lit(1)).alias("n"), F.max("frame.local_vars_size").cast(BIG).alias("largest"))


@query(
    """WITH r AS (SELECT lower(file_name) AS module FROM analyzed_files), m AS (SELECT lower(module_id) AS module, count(*) AS n FROM module_functions GROUP BY 1)
SELECT coalesce(r.module, m.module) AS module, CASE WHEN m.module IS NULL THEN 'only_left' WHEN r.module IS NULL THEN 'only_right' ELSE 'both' END AS verdict FROM r FULL JOIN m ON r.module = m.module"""
)
def consistency_full_outer(spark, d):
    r = registry(spark, d).select(F.lower("file_name").alias("module"), F.lit("x").alias("v"))
    m = fn(spark, d).groupBy("module").agg(F.lit("x").alias("v"))
    out = R.full_compare(r, m, ["module"], "v")
    return out.select("module", F.when(F.col("verdict") == "same", "both").otherwise(F.col("verdict")).alias("verdict"))


@query(
    "WITH"
    + _DEF
    + """, o AS (SELECT function_name AS name, list_distinct(flatten(list(dangerous))) AS l FROM f WHERE module < 'm' GROUP BY 1), n AS (SELECT function_name AS name, list_distinct(flatten(list(dangerous))) AS l FROM f WHERE module >= 'm' GROUP BY 1)
SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'common' END AS change,
 array_to_string(list_sort(list_filter(coalesce(n.l, []), lambda x: NOT list_contains(coalesce(o.l, []), x))), ',') AS gained, array_to_string(list_sort(list_filter(coalesce(o.l, []), lambda x: NOT list_contains(coalesce(n.l, []), x))), ',') AS lost
 FROM o FULL JOIN n ON o.name = n.name"""
)
def version_diff(spark, d):
    f = fn(spark, d).select("module", F.col("function_name").alias("name"), "dangerous")
    side = lambda c: f.where(c).groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list("dangerous"))).alias("apis"))
    return R.version_diff(side("module < 'm'"), side("module >= 'm'"), ["name"], "apis")


@query("WITH" + _DEF + "SELECT f.module, f.function_id, a.status, a.file_extension FROM f JOIN analyzed_files a ON lower(a.file_name) = f.module")
def with_module_info(spark, d):
    info = registry(spark, d).select(F.lower("file_name").alias("module"), "status", "file_extension")
    return R.lookup_join(fn(spark, d).select("module", "function_id"), info, ["module"])


@query(
    "WITH"
    + _DEF
    + """, x AS (SELECT f.module, f.function_id, x.function_name AS target, lower(x.module_name) AS tm FROM (SELECT module, function_id, unnest(outbound) AS x FROM f) f)
SELECT x.module, x.function_id, x.target, CASE WHEN m.module IS NULL THEN 'module_absent' WHEN t.fid IS NULL THEN 'function_absent' ELSE 'found' END AS state FROM x
 LEFT JOIN (SELECT DISTINCT module FROM f) m ON m.module = x.tm LEFT JOIN (SELECT module, lower(function_name) AS n, min(function_id) AS fid FROM f GROUP BY 1, 2) t ON t.module = x.tm AND t.n = lower(x.target)"""
)
def resolve_external(spark, d):
    f = fn(spark, d)
    x = f.select("module", "function_id", F.explode("outbound").alias("x")).select("module", "function_id", xref_name(F.col("x")).alias("target"), F.lower("x.module_name").alias("tm"), F.lower(xref_name(F.col("x"))).alias("n"))
    mods = f.select(F.col("module").alias("tm")).distinct().withColumn("known", F.lit(True))
    fns = f.groupBy(F.col("module").alias("tm"), F.lower("function_name").alias("n")).agg(F.min("function_id").alias("fid"))
    j = R.lookup_join(R.lookup_join(x, mods, ["tm"], "left"), fns, ["tm", "n"], "left")
    state = F.when(F.col("known").isNull(), "module_absent").when(F.col("fid").isNull(), "function_absent").otherwise("found")
    return j.select("module", "function_id", "target", state.alias("state"))


@query(
    "WITH"
    + _DEF
    + """, c AS (SELECT module, count(*) AS functions, count(*) FILTER (len(dangerous) > 0) AS risky, count(*) FILTER (len(strings) > 0) AS stringy FROM f GROUP BY 1)
SELECT module, functions, round(risky / functions, 4) AS risky_share, round(stringy / functions, 4) AS string_share, risky / functions >= 0.3 AS flagged FROM c"""
)
def module_fingerprint(spark, d):
    return measures.fingerprint(fn(spark, d))


@query("SELECT file_extension AS ext, status, count(*) AS n, CAST(grouping(file_extension, status) AS BIGINT) AS g FROM analyzed_files GROUP BY CUBE (file_extension, status)")
def registry_cube(spark, d):
    r = registry(spark, d).withColumnRenamed("file_extension", "ext")
    return R.cube_counts(r, ["ext", "status"]).withColumn("g", F.col("g").cast(BIG))


@query("SELECT base_dir, file_extension AS ext, count(*) AS n, CAST(grouping(base_dir, file_extension) AS BIGINT) AS g FROM analyzed_files GROUP BY ROLLUP (base_dir, file_extension)")
def registry_rollup(spark, d):
    r = registry(spark, d).withColumnRenamed("file_extension", "ext")
    return R.rollup_counts(r, ["base_dir", "ext"]).withColumn("g", F.col("g").cast(BIG))


@query("""SELECT regexp_extract(function_name, '^(.*)::[^:]+$', 1) AS class, count(*) AS methods, count(DISTINCT lower(module_id)) AS modules FROM module_functions WHERE function_name LIKE '%::%' GROUP BY 1""")
def class_members(spark, d):
    f = fn(spark, d).where("function_name LIKE '%::%'")
    return f.groupBy(F.regexp_extract("function_name", "^(.*)::[^:]+$", 1).alias("class")).agg(F.count(F.lit(1)).alias("methods"), F.count_distinct("module").alias("modules"))


@query()
def field_layouts(spark, d):
    return layouts.confidence(layouts.fields(layouts.accesses(fn(spark, d))))


@query(
    "WITH"
    + _DEF
    + """, n AS (SELECT DISTINCT x.function_name AS api FROM (SELECT unnest(outbound) AS x FROM f)), p AS (SELECT substr(term, 1, 5) AS prefix, min(sink_category) AS class FROM taxonomy WHERE kind = 'sink' GROUP BY 1)
SELECT api, max_by(class, length(prefix)) AS class FROM n LEFT JOIN p ON starts_with(api, prefix) GROUP BY 1"""
)
def prefix_classes(spark, d):
    n = fn(spark, d).select(F.explode("outbound").alias("x")).select(xref_name(F.col("x")).alias("api")).distinct()
    p = table(spark, d, "taxonomy").where("kind = 'sink'").groupBy(F.substring("term", 1, 5).alias("prefix")).agg(F.min("sink_category").alias("class"))
    return modules.classified(n, "api", p)


@query(
    "WITH"
    + _DEF
    + """, x AS (SELECT module, lower(x.module_name) AS t, x.function_name AS n FROM (SELECT module, unnest(outbound) AS x FROM f) WHERE x.function_id IS NULL AND coalesce(x.module_name, '') <> ''),
c AS (SELECT t AS module, n AS name, count(DISTINCT module) AS outside FROM x WHERE module <> t GROUP BY 1, 2)
SELECT f.module, f.function_id, coalesce(outside, 0) AS outside, CAST(least(1.0, 0.5 + least(0.15, 0.05 * coalesce(outside, 0))) AS DOUBLE) AS score FROM f LEFT JOIN c ON c.module = f.module AND c.name = f.function_name"""
)
def cross_module_boost(spark, d):
    f = fn(spark, d)
    calls = graph.external(graph.call_edges(f)).select("module", "dst_module", "dst")
    s = f.select("module", F.col("function_name").alias("name"), "function_id", F.lit(0.5).alias("score"))
    return modules.caller_boost(s, calls).select("module", "function_id", "outside", "score")


@query(
    """WITH c AS (SELECT lower(module_id) AS module, function_name AS src, list_distinct(regexp_extract_all(substr(decompiled_code, strpos(decompiled_code, '{')), '([A-Za-z_~][\\w:~]*)\\s*\\(', 1)) AS calls FROM module_functions WHERE decompiled_code IS NOT NULL),
e AS (SELECT DISTINCT module, src, unnest(calls) AS dst FROM c), n AS (SELECT DISTINCT lower(module_id) AS module, function_name FROM module_functions)
SELECT e.module, count(*) AS edges, count(DISTINCT e.src) AS callers FROM e JOIN n ON n.module = e.module AND n.function_name = e.dst WHERE e.src <> e.dst GROUP BY 1"""
)
def internal_call_edges(spark, d):
    """Calls in code to functions of the same module, by name."""
    f = fn(spark, d)
    e = f.where("decompiled_code IS NOT NULL").select("module", F.col("function_name").alias("src"), F.explode(scalar.calls_in(F.col("decompiled_code"))).alias("dst")).distinct()
    names = f.select("module", F.col("function_name").alias("dst")).distinct()
    inner = R.lookup_join(e, names, ["module", "dst"], "left_semi").where("src <> dst")
    return inner.groupBy("module").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("callers"))
