"""Queries on catalogs of interfaces: a catalog made of the module registry, its servers, clients, tiers and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.columns import table
from factloom.functions import scalar
from factloom.model import parsed_functions
from factloom.operators import catalogs as C
from factloom.operators import graph as G
from factloom.operators import interfaces as I
from factloom.operators import modules as M
from factloom.operators import reports as P
from factloom.plans.calls import _G, _nodes
from factloom.session import cut

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: b: a binary per file of the registry; i: two interfaces of each, the second one shared by all with names of like length; p: their procedures.
_I = r"""
b AS (SELECT file_path AS path, lower(regexp_extract(file_path, '([^/\\]*)$', 1)) AS module, file_extension AS ext, md5_hash AS m, status, length(file_name) AS n FROM analyzed_files WHERE file_path IS NOT NULL AND md5_hash IS NOT NULL),
i0 AS (SELECT path, module, ext, m AS interface_id, 1 + n % 3 AS cnt, 0 AS off, false AS is_client, CASE WHEN ext IN ('.dll', '.ocx') THEN 'svc' || (n % 7) END AS service, status = 'COMPLETE' AS running FROM b
 UNION ALL SELECT path, module, ext, 'shared-' || (n % 5), 2, 1, ext = '.exe', NULL, false FROM b),
i AS (SELECT *, CASE ext WHEN '.dll' THEN 'ncacn_np' WHEN '.sys' THEN 'ncacn_ip_tcp' WHEN '.ocx' THEN 'ncalrpc' END AS protocol,
 CASE WHEN ext = '.sys' THEN 'critical' WHEN ext = '.dll' THEN 'high' WHEN ext = '.ocx' AND running THEN 'medium' ELSE 'low' END AS tier FROM i0),
p AS (SELECT path, module, interface_id, 'proc' || (k - 1) AS procedure FROM (SELECT path, module, interface_id, cnt, off, sum(cnt) OVER (PARTITION BY path ORDER BY off) AS hi FROM i), LATERAL unnest(range(CAST(hi - cnt + 1 AS BIGINT), CAST(hi + 1 AS BIGINT))) AS u(k))
"""


def _binaries(spark, d) -> DataFrame:
    """The registry as catalog texts, one JSON object per file, read as a catalog."""
    f = table(spark, d, "analyzed_files").where("file_path IS NOT NULL AND md5_hash IS NOT NULL")
    n, ext = F.length("file_name"), F.col("file_extension")
    endpoint = F.when(ext == ".dll", F.concat(F.lit("ncacn_np:/pipe/"), "file_name")).when(ext == ".sys", "ncacn_ip_tcp:135").when(ext == ".ocx", "ncalrpc:local")
    points = F.when(endpoint.isNotNull(), F.array(endpoint)).otherwise(F.array().cast("array<string>"))
    one = lambda i, cnt, off, client, service, running: F.struct(i.alias("interface_id"), F.lit("1.0").alias("interface_version"), cnt.cast("int").alias("procedure_count"), F.lit(off).cast("bigint").alias("offset"), client.alias("is_client"), service.alias("service_name"), running.alias("is_service_running"), points.alias("endpoints"))
    own = one(F.col("md5_hash"), 1 + n % 3, 0, F.lit(False), F.when(ext.isin(".dll", ".ocx"), F.concat(F.lit("svc"), n % 7)), F.col("status") == "COMPLETE")
    shared = one(F.concat(F.lit("shared-"), n % 5), F.lit(2), 1, ext == ".exe", F.lit(None).cast("string"), F.lit(False))
    procs = F.concat(F.transform(F.sequence(F.lit(0), 2 + n % 3), lambda k: F.concat(F.lit("proc"), k)), F.array(F.lit("0x18000A0B0")))
    text = F.to_json(F.create_map(F.col("file_path"), F.struct(F.col("file_path").alias("binary_path"), F.array(own, shared).alias("interfaces"), procs.alias("procedures"))))
    return C.binaries(f.select(text.alias("catalog")), "catalog")


@query("WITH" + _I + " SELECT path, module, interface_id, is_client, coalesce(protocol, '') AS protocol, tier FROM i")
def catalog_interfaces(spark, d):
    i = C.interfaces(_binaries(spark, d))
    return i.select("path", "module", "interface_id", "is_client", F.array_join("protocols", ",").alias("protocol"), "tier")


@query("WITH" + _I + " SELECT module, interface_id, procedure FROM p")
def catalog_procedures(spark, d):
    return C.procedures(_binaries(spark, d))


@query("WITH" + _I + " SELECT tier, count(*) AS n, count(DISTINCT module) AS modules, CAST(CASE tier WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS INTEGER) AS place FROM i GROUP BY 1")
def catalog_tiers(spark, d):
    """Interfaces per tier, the worst first."""
    t = C.by_tier(C.interfaces(_binaries(spark, d)))
    return t.withColumn("place", F.array_position(F.array(*map(F.lit, C.TIERS)), F.col("tier")).cast("int")).orderBy("place", F.desc("n"))


@query("WITH" + _I + " SELECT coalesce(service, '(no service)') AS service, count(DISTINCT interface_id) AS n FROM i GROUP BY 1")
def catalog_services(spark, d):
    return C.by_service(C.interfaces(_binaries(spark, d)))


@query(
    "WITH"
    + _I
    + """ SELECT interface_id, coalesce(array_to_string(list_sort(list(DISTINCT module) FILTER (NOT is_client)), ','), '') AS servers, coalesce(array_to_string(list_sort(list(DISTINCT module) FILTER (is_client)), ','), '') AS clients, min(service) AS service FROM i GROUP BY 1"""
)
def catalog_topology(spark, d):
    t = C.topology(C.interfaces(_binaries(spark, d)))
    return t.select("interface_id", F.array_join("servers", ",").alias("servers"), F.array_join("clients", ",").alias("clients"), "service")


@query("WITH" + _I + " SELECT count(*) FILTER (protocol IN ('ncacn_ip_tcp', 'ncacn_http')) AS remote, count(*) FILTER (protocol = 'ncacn_np') AS pipe, count(*) FILTER (protocol = 'ncalrpc') AS local_, count(*) FILTER (is_client) AS clients, count(*) FILTER (NOT is_client) AS servers, count(*) AS n FROM i")
def catalog_predicates(spark, d):
    i = C.interfaces(_binaries(spark, d))
    has = lambda *p: F.count_if(F.arrays_overlap("protocols", F.array(*map(F.lit, p))))
    return i.agg(has("ncacn_ip_tcp", "ncacn_http").alias("remote"), has("ncacn_np").alias("pipe"), has("ncalrpc").alias("local_"), F.count_if("is_client").alias("clients"), F.count_if(~F.col("is_client")).alias("servers"), F.count(F.lit(1)).alias("n"))


_EDGES = """, ce_ AS (SELECT DISTINCT c.module AS src_module, p.module AS dst_module, p.procedure FROM (SELECT DISTINCT interface_id, module FROM i WHERE is_client) c JOIN p USING (interface_id) WHERE c.module <> p.module)"""


def _client_edges(spark, d) -> DataFrame:
    b = cut(_binaries(spark, d))
    return C.client_edges(C.interfaces(b), C.procedures(b))


@query("WITH" + _I + _EDGES + " SELECT * FROM ce_")
def catalog_client_edges(spark, d):
    return _client_edges(spark, d)


@query("WITH" + _I + ", t AS (SELECT DISTINCT interface_id FROM i WHERE interface_id LIKE 'shared-%'), s AS (SELECT DISTINCT t.interface_id, x.interface_id AS sibling FROM t JOIN i a ON a.interface_id = t.interface_id JOIN i x ON (x.service = a.service OR x.path = a.path) AND x.interface_id <> t.interface_id) SELECT interface_id, count(*) AS siblings FROM s GROUP BY 1")
def catalog_blast_radius(spark, d):
    """Interfaces that share a service or a binary with each of the shared ones."""
    i = cut(C.interfaces(_binaries(spark, d)))
    t = i.where("startswith(interface_id, 'shared-')").select("interface_id").distinct()
    return C.blast_radius(i, t).groupBy("interface_id").agg(F.count(F.lit(1)).alias("siblings"))


@query("WITH" + _I + ", w AS (SELECT DISTINCT lower(module_id) AS module FROM module_functions) SELECT 'interfaces' AS kind, module FROM w WHERE module IN (SELECT module FROM i WHERE NOT is_client) UNION ALL SELECT 'clients', module FROM w WHERE module IN (SELECT module FROM i WHERE is_client)")
def catalog_intersection(spark, d):
    """Modules of the workspace that each catalog knows."""
    i = cut(C.interfaces(_binaries(spark, d)))
    loaded = table(spark, d, "module_functions").select(F.lower("module_id").alias("module")).distinct()
    return C.present_in(loaded, {"interfaces": i.where("NOT is_client"), "clients": i.where("is_client")})


@query(
    "WITH"
    + _I
    + """, c AS (SELECT DISTINCT module FROM i WHERE is_client), s AS (SELECT DISTINCT module FROM i WHERE NOT is_client AND tier = 'critical') SELECT module AS src_module, '(any server)' AS dst_module FROM c UNION SELECT '(any server)', module FROM s"""
)
def fallback_edges(spark, d):
    """Clients to servers where no edge is known: all lead through one node."""
    i = cut(C.interfaces(_binaries(spark, d)))
    none = spark.createDataFrame([], "src_module string, dst_module string")
    return M.fallback_edges(none, i.where("is_client").select("module"), i.where("NOT is_client AND tier = 'critical'").select("module"))


_SITES = """, sites AS (SELECT module, CASE WHEN interface_id LIKE 'shared-%' AND right(interface_id, 1) <> '4' THEN interface_id WHEN right(interface_id, 1) = '4' THEN NULL ELSE 'gone' END AS class_id FROM i WHERE ext = '.exe'),
known AS (SELECT DISTINCT s.module AS src_module, p.module AS dst_module, p.procedure, 'resolved' AS edge_type FROM sites s JOIN p ON p.interface_id = s.class_id WHERE s.module <> p.module),
lost AS (SELECT DISTINCT module FROM sites WHERE class_id IS NULL OR class_id NOT IN (SELECT interface_id FROM p))"""


@query("WITH" + _I + _SITES + " SELECT * FROM known UNION ALL SELECT module, '(any server)', NULL, 'unresolved' FROM lost UNION ALL SELECT DISTINCT '(any server)', module, procedure, 'unresolved' FROM p WHERE EXISTS (SELECT 1 FROM lost)")
def activation_edges(spark, d):
    """Call sites of classes to their servers; those of unknown classes to any server."""
    b = cut(_binaries(spark, d))
    i, last = C.interfaces(b), F.right(F.col("interface_id"), F.lit(1))
    cls = F.when(F.startswith(F.col("interface_id"), F.lit("shared-")) & (last != "4"), F.col("interface_id")).when(last == "4", F.lit(None).cast("string")).otherwise("gone")
    sites = i.where(F.lower("path").endswith(".exe")).select("module", cls.alias("class_id"))
    return M.activation_edges(sites, C.procedures(b).select(F.col("interface_id").alias("class_id"), "module", "procedure"))


@query(
    "WITH RECURSIVE"
    + _G
    + ", "
    + _I.strip()
    + _EDGES
    + """, own AS (SELECT DISTINCT module, src FROM ce), allg AS (SELECT src, dst FROM g UNION SELECT o.module || '!' || o.src, 'gate:' || o.module FROM own o WHERE o.module IN (SELECT src_module FROM ce_) UNION SELECT 'gate:' || src_module, dst_module || '!' || procedure FROM ce_),
e0 AS (SELECT DISTINCT o.module || '!' || o.src AS entry FROM own o WHERE o.module LIKE '%.exe'), r(entry, node, depth) AS (SELECT entry, entry, 0 FROM e0 UNION SELECT r.entry, a.dst, r.depth + 1 FROM r JOIN allg a ON a.src = r.node WHERE r.depth < 3), m AS (SELECT entry, node, min(depth) AS depth FROM r GROUP BY 1, 2)
SELECT split_part(node, '!', 1) AS module, depth, count(*) AS n FROM m WHERE node NOT LIKE 'gate:%' GROUP BY 1, 2"""
)
def cross_module_reach(spark, d):
    """What functions of programs reach over calls and interfaces: nodes per module and depth."""
    e = G.call_edges(parsed_functions(table(spark, d, "module_functions")))
    calls = cut(e.select("module", "src", "dst_module", "dst").distinct())
    starts = calls.where("endswith(module, '.exe')").select(F.concat_ws("!", "module", "src").alias("entry")).distinct()
    r = P.cross_module_reach(calls, _client_edges(spark, d), starts, 3)
    return r.groupBy("module", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("WITH" + _G + ", " + _I.strip() + _EDGES + " SELECT 'call' AS edge_type, count(*) AS n FROM g UNION ALL SELECT 'interface', count(*) FROM (SELECT DISTINCT src_module, dst_module || '!' || procedure FROM ce_)")
def unified_edges(spark, d):
    """Edges of calls and of interfaces in one table, counted by kind."""
    calls = _nodes(G.call_edges(parsed_functions(table(spark, d, "module_functions"))))
    ipc = _client_edges(spark, d).select(F.col("src_module").alias("src"), F.concat_ws("!", "dst_module", "procedure").alias("dst")).distinct()
    return G.unified_edges([("call", calls), ("interface", ipc)]).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


#: c: contexts of each server, by the registry.
_X = _I + ", c AS (SELECT module AS server, CASE WHEN ext IN ('.dll', '.exe') THEN 'low' ELSE 'medium' END AS caller, status = 'COMPLETE' AS privileged, ext = '.sys' AS remote FROM b)"


def _contexts(spark, d) -> DataFrame:
    f = table(spark, d, "analyzed_files").where("file_path IS NOT NULL AND md5_hash IS NOT NULL")
    ext = F.col("file_extension")
    return f.select(F.lower(F.regexp_extract("file_path", r"([^/\\]*)$", 1)).alias("server"), F.when(ext.isin(".dll", ".exe"), "low").otherwise("medium").alias("caller"), (F.col("status") == "COMPLETE").alias("privileged"), (ext == ".sys").alias("remote"))


@query("WITH" + _X + " SELECT DISTINCT server FROM c WHERE caller = 'low' AND privileged")
def privileged_surface(spark, d):
    c = _contexts(spark, d)
    return C.privileged(c.select("server").distinct(), c, "low")


@query("WITH" + _X + ", t AS (SELECT server, CASE WHEN privileged AND remote THEN 1 WHEN privileged AND caller = 'low' THEN 2 WHEN privileged OR remote THEN 3 ELSE 4 END AS k FROM c) SELECT server, CASE min(k) WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END AS tier FROM t GROUP BY 1")
def best_tiers(spark, d):
    return C.best_tier(_contexts(spark, d))


@query("WITH" + _X + ", n AS (SELECT server, bool_or(privileged) AS a, bool_or(remote) AS r, max(length(server)) AS methods FROM c GROUP BY 1) SELECT server, round(CASE WHEN methods <= 8 THEN 0 ELSE least(1.0, CASE WHEN a THEN 0.4 ELSE 0 END + CASE WHEN r THEN 0.3 ELSE 0 END + 0.1 * least(methods / 20, 1.0)) END, 6) AS score FROM n")
def server_scores(spark, d):
    n = _contexts(spark, d).groupBy("server").agg(F.bool_or("privileged").alias("a"), F.bool_or("remote").alias("r"), F.max(F.length("server")).alias("methods"))
    return n.select("server", F.round(C.flag_score([(F.col("a"), 0.4), (F.col("r"), 0.3)], F.col("methods"), F.lit(8)), 6).alias("score"))


@query("SELECT lower(module_id) AS module, function_id FROM module_functions WHERE regexp_matches(function_name, '(?i)(session|token)')")
def methods_by_pattern(spark, d):
    return C.methods_matching(table(spark, d, "module_functions"), "function_name", "(session|token)").select(F.lower("module_id").alias("module"), "function_id")


@query(
    """WITH s AS (SELECT file_name, CASE file_extension WHEN '.exe' THEN 'O:SYG:SYD:(A;;GA;;;WD)(D;;GW;;;BU)' WHEN '.dll' THEN 'D:(A;;GA;;;SY)(A;;GR;;;BA)' WHEN '.sys' THEN 'D:(A;;GA;;;AU)(D;;GA;;;AU)' END AS sddl, file_extension AS ext FROM analyzed_files)
SELECT file_name, CAST(CASE ext WHEN '.ocx' THEN NULL ELSE 2 END AS BIGINT) AS entries, ext = '.exe' AS wide FROM s"""
)
def descriptor_access(spark, d):
    """Security descriptors: their entries, and whether they let a wide group in."""
    ext = F.col("file_extension")
    sddl = F.when(ext == ".exe", "O:SYG:SYD:(A;;GA;;;WD)(D;;GW;;;BU)").when(ext == ".dll", "D:(A;;GA;;;SY)(A;;GR;;;BA)").when(ext == ".sys", "D:(A;;GA;;;AU)(D;;GA;;;AU)")
    f = table(spark, d, "analyzed_files").withColumn("s", sddl)
    n = F.when(F.col("s").isNotNull(), F.size(C.aces(F.col("s")))).cast("bigint")
    return f.select("file_name", n.alias("entries"), C.permissive(F.col("s")).alias("wide"))


# ---------------------------------------------------------------- classes and interfaces in code


@query(
    """WITH m AS (SELECT lower(module_id) AS module, function_name, CASE WHEN function_name LIKE '%::~%' OR starts_with(function_name, '~') THEN 'destructor' WHEN function_name LIKE '%::%' THEN 'method' ELSE 'function' END AS role FROM module_functions WHERE function_name IS NOT NULL),
c AS (SELECT module, CASE WHEN role = 'function' THEN '' ELSE regexp_extract(function_name, '^(.*)::[^:]+$', 1) END AS class, role FROM m) SELECT module, class, role, count(*) AS n FROM c GROUP BY 1, 2, 3"""
)
def interface_roles(spark, d):
    return I.implementations(table(spark, d, "module_functions").select(F.lower("module_id").alias("module"), "function_name"))


@query(
    """WITH v AS (SELECT lower(module_id) AS module, function_id, unnest(json_extract_string(vtable_contexts, '$[*].reconstructed_classes[*]')) AS skeleton FROM module_functions WHERE vtable_contexts LIKE '[{%')
SELECT module, skeleton, min(function_id) AS function_id, count(*) AS copies FROM v WHERE skeleton <> '' GROUP BY 1, 2"""
)
def class_skeletons(spark, d):
    """Skeletons of classes once per module, under the first function that shows each."""
    f = parsed_functions(table(spark, d, "module_functions"))
    v = f.select("module", "function_id", F.explode("vtables").alias("v")).select("module", "function_id", F.explode("v.reconstructed_classes").alias("skeleton"))
    return I.first_skeletons(v)


@query(
    """WITH k(n, ms, class) AS (VALUES (0, ['QueryInterface', 'AddRef', 'Release', 'GetIids', 'GetRuntimeClassName', 'GetTrustLevel'], 'x'), (1, ['QueryInterface', 'AddRef', 'Release', 'Run'], 'x'), (2, ['Run', 'AddRef', 'Release'], 'x'), (3, ['Run'], 'IFoo'), (4, ['Run'], 'foo'))
SELECT file_name, CASE length(file_name) % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'none' END AS grade, CASE length(file_name) % 5 WHEN 0 THEN 'IInspectable' WHEN 4 THEN NULL ELSE 'IUnknown' END AS base, CAST(CASE length(file_name) % 5 WHEN 0 THEN 6 WHEN 1 THEN 3 ELSE 0 END AS INTEGER) AS first_own FROM analyzed_files"""
)
def table_grades(spark, d):
    """How surely a table of methods is an interface's, by its first slots, any slot, or its class's name."""
    n = F.length("file_name") % 5
    base = [F.lit(x) for x in ("QueryInterface", "AddRef", "Release")]
    ms = F.when(n == 0, F.array(*base, F.lit("GetIids"), F.lit("GetRuntimeClassName"), F.lit("GetTrustLevel"))).when(n == 1, F.array(*base, F.lit("Run"))).when(n == 2, F.array(F.lit("Run"), F.lit("AddRef"), F.lit("Release"))).otherwise(F.array(F.lit("Run")))
    g = I.table_grade(ms, F.when(n == 3, "IFoo").otherwise("foo"))
    return table(spark, d, "analyzed_files").select("file_name", g.alias("g")).select("file_name", "g.grade", "g.base", "g.first_own")


@query(
    """SELECT file_name, length(file_name) % 4 AS flags, length(file_name) % 2 = 0 AS weak, 'IA,IB<IC,ID>' AS interfaces, true AS free_threaded FROM analyzed_files"""
)
def template_decode(spark, d):
    """The flags and interfaces that runtime-class templates name."""
    n = F.length("file_name")
    name = F.concat(F.lit("Microsoft::WRL::Details::RuntimeClassImpl<Microsoft::WRL::RuntimeClassFlags<"), n % 4, F.lit(">,"), F.when(n % 2 == 0, "1").otherwise("0"), F.lit(",0,0,IA,IB<IC,ID>,Microsoft::WRL::FtmBase>::QueryInterface"))
    t = I.template(name)
    return table(spark, d, "analyzed_files").select("file_name", t.alias("t")).select("file_name", F.col("t.flags").cast("bigint").alias("flags"), "t.weak", F.array_join("t.interfaces", ",").alias("interfaces"), "t.free_threaded")


@query("""WITH t AS (SELECT file_extension AS e, 'RuntimeClass' || (length(file_name) % 3) AS c, length(file_name) % 3 AS k FROM analyzed_files) SELECT c AS class, CASE WHEN k = 1 THEN 'IA,IB<IC,ID>' ELSE 'IA' END AS interfaces FROM t WHERE e IS NOT NULL GROUP BY c, k""")
def class_interface_map(spark, d):
    """The interfaces that templates list for each class."""
    k = F.length("file_name") % 3
    name = F.concat(F.lit("RuntimeClass"), k, F.lit("::Base<RuntimeClass<RuntimeClassFlags<1>,IA"), F.when(k == 1, ",IB<IC,ID>").otherwise(""), F.lit(">::Run"))
    f = table(spark, d, "analyzed_files").where("file_extension IS NOT NULL").select(name.alias("n"))
    m = I.class_interfaces(f.select(F.col("n")), "n")
    return m.groupBy(F.regexp_extract("class", "^(RuntimeClass[0-9])", 1).alias("class")).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("interfaces")))), ",").alias("interfaces"))


@query("""SELECT file_name, count(*) AS guids FROM (SELECT file_name, unnest(regexp_extract_all('id ' || substr(md5_hash, 1, 8) || '-' || substr(md5_hash, 9, 4) || '-' || substr(md5_hash, 13, 4) || '-' || substr(md5_hash, 17, 4) || '-' || substr(md5_hash, 21, 12) || ' end', '[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}')) AS g FROM analyzed_files) GROUP BY 1""")
def guids_in_text(spark, d):
    h = lambda a, n: F.substring("md5_hash", a, n)
    text = F.concat(F.lit("id "), F.concat_ws("-", h(1, 8), h(9, 4), h(13, 4), h(17, 4), h(21, 12)), F.lit(" end"))
    f = table(spark, d, "analyzed_files").where("md5_hash IS NOT NULL").select("file_name", F.explode(I.guids(text)).alias("g"))
    return f.groupBy("file_name").agg(F.count(F.lit(1)).alias("guids"))


@query("""WITH t(i, ty, r) AS (VALUES (0, 'byte[]', 0.9), (1, 'string[]', 0.85), (2, 'NdrInterfacePointer', 0.7), (3, 'int[]', 0.6), (4, 'Struct_3', 0.6), (5, 'int', 0.3), (6, 'other', 0.5)) SELECT file_name, CAST(r AS DOUBLE) AS risk FROM analyzed_files JOIN t ON i = length(file_name) % 7""")
def parameter_type_risk(spark, d):
    n = F.length("file_name") % 7
    types = F.array(*map(F.lit, ("byte[]", "string[]", "NdrInterfacePointer", "int[]", "Struct_3", "int", "other")))
    return table(spark, d, "analyzed_files").select("file_name", scalar.wire_type_risk(F.get(types, n)).alias("risk"))


@query(
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(l, 'auth|login|credential|token|identity|impersonat') THEN 'authentication' WHEN regexp_matches(l, 'crypt|encrypt|decrypt|hash|sign|verify|cert') THEN 'crypto' WHEN NOT regexp_matches(l, 'async') AND regexp_matches(l, 'file|folder|directory|path|stream|storage|read|write|open|create|delete') THEN 'file_io' WHEN regexp_matches(l, 'network|socket|http|url|connect|download|upload|remote') THEN 'network' WHEN regexp_matches(l, 'process|launch|execute|run|spawn|shutdown|reboot') THEN 'process' WHEN regexp_matches(l, 'registry|regkey|hkey') THEN 'registry' WHEN regexp_matches(l, 'system|update|install|config|setting|policy|timezone|power') THEN 'system_management' WHEN regexp_matches(l, 'elevat|admin|privilege|uac|consent') THEN 'elevation' WHEN regexp_matches(l, 'marshal|unmarshal|proxy|stub|interface') THEN 'marshalling' WHEN regexp_matches(l, 'get_|put_|set_|query|enum|list|find|search|exists|tryget|add|remove') THEN 'data_access' WHEN regexp_matches(l, 'add_|remove_|event|changed|notify|callback') THEN 'event' WHEN regexp_matches(l, 'async|await|operation|task') THEN 'async_operation' ELSE 'other' END AS kind FROM (SELECT lower(function_name) AS l FROM module_functions WHERE function_name IS NOT NULL)) GROUP BY 1"""
)
def method_kinds(spark, d):
    f = table(spark, d, "module_functions").where("function_name IS NOT NULL")
    return f.groupBy(scalar.method_kind(F.col("function_name")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
