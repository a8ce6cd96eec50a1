"""Queries on the graph of calls between functions: reach, levels, reports, imports, exports and callbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.columns import table
from factloom.model import parsed_functions
from factloom.operators import graph as G
from factloom.operators import modules as M
from factloom.operators import relational as R
from factloom.operators import reports as P
from factloom.operators import search as S
from factloom.plans.facts import _DEF
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


#: ce: calls as listed; g: the same between module!name nodes; d: defined nodes; s: entries (functions named OnDispatch).
_G = (
    _DEF
    + """, x AS (SELECT module, function_name AS src, unnest(outbound) AS x FROM f),
ce AS (SELECT DISTINCT module, src, x.function_name AS dst, x.function_id AS dst_id, lower(x.module_name) AS dst_module FROM x WHERE src IS NOT NULL AND x.function_name IS NOT NULL AND lower(coalesce(x.module_name, '')) <> 'data' AND coalesce(x.function_type, 0) <> 4),
g AS (SELECT DISTINCT module || '!' || src AS src, coalesce(nullif(dst_module, ''), module) || '!' || dst AS dst FROM ce),
d AS (SELECT DISTINCT module || '!' || function_name AS node FROM f WHERE function_name IS NOT NULL), s AS (SELECT node AS entry FROM d WHERE lower(node) LIKE '%!ondispatch')"""
)


def _reach(depth: int, edges: str = "g", start: str = "s") -> str:
    """SQL of m: (entry, node, depth) within so many steps."""
    return f""", r(entry, node, depth) AS (SELECT entry, entry, 0 FROM {start} UNION SELECT r.entry, e.dst, r.depth + 1 FROM r JOIN {edges} e ON e.src = r.node WHERE r.depth < {depth}),
m AS (SELECT entry, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2)"""


def _parsed(spark, d) -> DataFrame:
    return parsed_functions(table(spark, d, "module_functions"))


def _node(m, n):
    return F.concat_ws("!", m, n)


def _nodes(e: DataFrame) -> DataFrame:
    """(src, dst) between module!name nodes."""
    own = F.coalesce(F.when(F.col("dst_module") != "", F.col("dst_module")), F.col("module"))
    return e.select(_node(F.col("module"), F.col("src")).alias("src"), _node(own, F.col("dst")).alias("dst")).distinct()


def _defined(f: DataFrame) -> DataFrame:
    return f.where("function_name IS NOT NULL").select(_node(F.col("module"), F.col("function_name")).alias("node")).distinct()


def _parts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges between nodes, defined nodes, entries."""
    f = _parsed(spark, d)
    n = cut(_defined(f))
    return cut(_nodes(G.call_edges(f))), n, n.where(F.lower("node").endswith("!ondispatch")).select(F.col("node").alias("entry"))


@query("WITH" + _G + " SELECT module, src, dst, dst_id, coalesce(dst_module, '') AS dst_module FROM ce")
def call_edges(spark, d):
    return G.call_edges(_parsed(spark, d)).withColumn("dst_module", F.coalesce("dst_module", F.lit("")))


@query("WITH" + _G + " SELECT module, dst_module, count(*) AS n, count(DISTINCT dst) AS names FROM ce WHERE dst_id IS NULL AND coalesce(dst_module, '') <> '' GROUP BY 1, 2")
def external_calls(spark, d):
    return G.external(G.call_edges(_parsed(spark, d))).groupBy("module", "dst_module").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("names"))


@query("WITH" + _DEF + ", x AS (SELECT module, unnest(outbound) AS x FROM f) SELECT module, count(*) FILTER (lower(coalesce(x.module_name, '')) <> 'data' AND coalesce(x.function_type, 0) <> 4) AS followable, count(*) FILTER (lower(coalesce(x.module_name, '')) NOT IN ('data', 'vtable') AND coalesce(x.function_type, 0) NOT IN (4, 8)) AS without_tables, count(*) AS n FROM x GROUP BY 1")
def followable_edges(spark, d):
    x = _parsed(spark, d).select("module", F.explode("outbound").alias("x"))
    return x.groupBy("module").agg(F.count_if(G.followable(F.col("x"))).alias("followable"), F.count_if(G.followable(F.col("x"), False)).alias("without_tables"), F.count(F.lit(1)).alias("n"))


@query("WITH RECURSIVE" + _G + _reach(4) + " SELECT entry, node, depth FROM m")
def call_reach(spark, d):
    e, _, s = _parts(spark, d)
    return G.reach(e, s, 4)


@query("WITH RECURSIVE" + _G + ", k AS (SELECT * FROM g WHERE NOT contains(dst, '!sub_'))" + _reach(4, "k") + " SELECT entry, node, depth FROM m")
def call_reach_allowed(spark, d):
    """Reach over edges that a condition allows."""
    e, _, s = _parts(spark, d)
    return G.reach(e, s, 4, ~F.contains(F.col("dst"), F.lit("!sub_")))


@query("WITH RECURSIVE" + _G + ", k AS (SELECT * FROM g WHERE src IN (SELECT node FROM d) AND dst IN (SELECT node FROM d))" + _reach(6, "k") + " SELECT entry, node, depth FROM m")
def call_reach_internal(spark, d):
    e, n, s = _parts(spark, d)
    return G.reach_internal(e, n, s, 6)


@query(
    "WITH RECURSIVE"
    + _G
    + ", r(a, b) AS (SELECT src, dst FROM g WHERE src <> dst UNION SELECT r.a, g.dst FROM r JOIN g ON g.src = r.b) SELECT x.a AS node, max(greatest(x.a, x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1"
)
def call_components(spark, d):
    """Groups of functions that call each other, directly or not."""
    return G.components(_parts(spark, d)[0])


@query(
    "WITH RECURSIVE"
    + _G
    + """, q AS (SELECT * FROM g WHERE src <> dst), r(a, b) AS (SELECT src, dst FROM q UNION SELECT r.a, q.dst FROM r JOIN q ON q.src = r.b), loops AS (SELECT a AS node FROM r WHERE a = b), n AS (SELECT src AS node FROM q UNION SELECT dst FROM q),
cyclic AS (SELECT node FROM loops UNION SELECT a FROM r JOIN loops ON b = node),
l(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT node FROM cyclic) UNION SELECT q.src, l.level + 1 FROM l JOIN q ON q.dst = l.node WHERE q.src NOT IN (SELECT node FROM cyclic))
SELECT node, CAST(-1 AS INTEGER) AS level FROM cyclic UNION ALL SELECT node, CAST(max(level) AS INTEGER) FROM l GROUP BY 1"""
)
def call_levels(spark, d):
    """Callees first."""
    return G.levels(_parts(spark, d)[0])


@query("WITH" + _G + ", l AS (SELECT DISTINCT module FROM f) SELECT DISTINCT module, dst_module FROM ce WHERE dst_id IS NULL AND dst_module <> module AND dst_module IN (SELECT module FROM l)")
def module_dependency_map(spark, d):
    f = _parsed(spark, d)
    return G.module_edges(G.call_edges(f), f)


_LONG = "SELECT 'stats' AS part, 'nodes' AS item, count(*) AS n FROM (SELECT src FROM g UNION SELECT dst FROM g UNION SELECT node FROM d) UNION ALL SELECT 'stats', 'edges', count(*) FROM g UNION ALL SELECT 'stats', 'defined', count(*) FROM d"


@query(
    "WITH RECURSIVE"
    + _G
    + _reach(8)
    + ", k AS (SELECT src AS node, 0 AS i, 1 AS o FROM g UNION ALL SELECT dst, 1, 0 FROM g), h AS (SELECT node, sum(i) AS i, sum(o) AS o FROM k GROUP BY 1) "
    + _LONG
    + """ UNION ALL SELECT 'depth', CAST(depth AS VARCHAR), count(*) FROM m GROUP BY 2 UNION ALL SELECT 'bottleneck', node, CAST(i * o AS BIGINT) FROM h WHERE i >= 3 AND o >= 3
UNION ALL SELECT 'leaves', '', count(DISTINCT dst) FROM g WHERE dst NOT IN (SELECT src FROM g) UNION ALL SELECT 'roots', '', count(DISTINCT src) FROM g WHERE src NOT IN (SELECT dst FROM g)
UNION ALL SELECT 'dead', '', count(*) FROM d WHERE node NOT IN (SELECT dst FROM g WHERE src <> dst) AND node NOT IN (SELECT entry FROM s)"""
)
def call_topology(spark, d):
    """The topology report as one table: (part, item, n)."""
    e, n, s = _parts(spark, d)
    t = P.topology(e, n, s, 8)
    one = lambda part, item, value: F.struct(F.lit(part).alias("part"), item.cast("string").alias("item"), value.cast("bigint").alias("n"))
    stats = t["stats"].select(F.inline(F.array(*[one("stats", F.lit(c), F.col(c)) for c in ("nodes", "edges", "defined")])))
    parts = [stats, t["depths"].select(F.inline(F.array(one("depth", F.col("depth"), F.col("n"))))), t["bottlenecks"].select(F.inline(F.array(one("bottleneck", F.col("node"), F.col("score")))))]
    parts += [t[k].agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(one(k, F.lit(""), F.col("n"))))) for k in ("leaves", "roots", "dead")]
    return reduce(DataFrame.unionByName, parts)


@query("WITH RECURSIVE" + _G + _reach(2) + " SELECT DISTINCT entry, dst AS name FROM m JOIN g ON g.src = m.node")
def transitive_calls(spark, d):
    e, _, s = _parts(spark, d)
    return P.transitive_calls(e, s, 2)


@query(
    "WITH RECURSIVE"
    + _G
    + _reach(3)
    + """, t AS (SELECT DISTINCT entry, split_part(dst, '!', -1) AS name FROM m JOIN g ON g.src = m.node), a AS (SELECT entry, bool_or(name = 'Invoke') AS q, bool_or(name = 'Next') AS w FROM t GROUP BY 1)
SELECT entry, CASE WHEN q THEN '' ELSE 'Invoke' END AS missing, CASE WHEN w THEN 'Next' ELSE '' END AS found, CASE WHEN NOT q AND w THEN 'high' WHEN w THEN 'medium' WHEN NOT q THEN 'low' ELSE 'ok' END AS verdict FROM a"""
)
def handler_audit(spark, d):
    """Which names each entry's calls have to hold, or must not."""
    e, _, s = _parts(spark, d)
    calls = P.transitive_calls(e, s, 3).select("entry", F.element_at(F.split("name", "!"), -1).alias("name")).distinct()
    return P.handler_audit(calls, ["Invoke"], ["Next"])


@query(
    "WITH RECURSIVE"
    + _G
    + _reach(4)
    + """, k AS (SELECT m.depth, CASE WHEN contains(node, '!sub_') THEN 'unnamed' WHEN contains(node, '::') THEN 'method' ELSE 'other' END AS kind FROM m)
SELECT depth, count(*) FILTER (kind = 'unnamed') AS unnamed, count(*) FILTER (kind = 'method') AS method, count(*) FILTER (kind = 'other') AS other FROM k GROUP BY 1"""
)
def traversal_plan(spark, d):
    e, _, s = _parts(spark, d)
    r = G.reach(e, s, 4)
    kind = F.when(F.contains(F.col("node"), F.lit("!sub_")), "unnamed").when(F.contains(F.col("node"), F.lit("::")), "method")
    return P.traversal_plan(r, r.select("node").distinct().select("node", kind.alias("kind")), ["unnamed", "method"])


@query(
    "WITH RECURSIVE"
    + _G
    + ", one AS (SELECT min(entry) AS entry FROM s), e1 AS (SELECT g.src, g.dst, CASE WHEN split_part(g.src, '!', 1) = split_part(g.dst, '!', 1) THEN '' ELSE split_part(g.dst, '!', 1) END AS dst_module FROM g)"
    + _reach(4, "g", "one")
    + " SELECT min(e.src) AS parent, e.dst AS child, min(y.depth) AS depth, CASE WHEN max(dst_module) = '' THEN 'internal' ELSE 'external' END AS kind FROM e1 e JOIN m x ON x.node = e.src JOIN m y ON y.node = e.dst WHERE y.depth = x.depth + 1 GROUP BY 2"
)
def call_tree(spark, d):
    """Each function that one entry leads to, once, under its least caller of the level above."""
    e, _, s = _parts(spark, d)
    module = lambda c: F.split_part(c, F.lit("!"), F.lit(1))
    e = e.withColumn("dst_module", F.when(module("src") == module("dst"), "").otherwise(module("dst")))
    return P.call_tree(e, s.agg(F.min("entry").alias("entry")).where("entry IS NOT NULL"), 4)


@query(
    "WITH RECURSIVE"
    + _G
    + ", named AS (SELECT src, dst FROM g WHERE NOT contains(dst, '!sub_') AND NOT contains(src, '!sub_'))"
    + _reach(5, "named")
    + " SELECT entry, count(*) - 1 AS dependents FROM m GROUP BY 1"
)
def dependent_sets(spark, d):
    """How many functions each entry depends on, unnamed ones skipped as a library's would be."""
    e, n, s = _parts(spark, d)
    skipped = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().where(F.contains(F.col("node"), F.lit("!sub_")))
    return R.without_nodes(e, skipped).transform(lambda k: G.reach(k, s, 5)).groupBy("entry").agg((F.count(F.lit(1)) - 1).alias("dependents"))


_DOSSIER = """, one AS (SELECT min(entry) AS entry FROM s), back AS (SELECT dst AS src, src AS dst FROM g), ends AS (SELECT src AS entry FROM g WHERE src NOT IN (SELECT dst FROM g))"""


@query(
    "WITH RECURSIVE"
    + _G
    + _DOSSIER
    + """, u(node, depth) AS (SELECT entry, 0 FROM one UNION SELECT b.dst, u.depth + 1 FROM u JOIN back b ON b.src = u.node WHERE u.depth < 5), w AS (SELECT node, min(depth) AS depth FROM u GROUP BY 1),
v(node, depth) AS (SELECT entry, 0 FROM one UNION SELECT g.dst, v.depth + 1 FROM v JOIN g ON g.src = v.node WHERE v.depth < 5), z AS (SELECT node, min(depth) AS depth FROM v GROUP BY 1),
k AS (SELECT module || '!' || function_name AS node, unnest(dangerous) AS api FROM f), kd AS (SELECT DISTINCT node, api FROM k)
SELECT 'caller' AS part, node AS item, CAST(depth AS BIGINT) AS n FROM w UNION ALL SELECT 'neighbour ' || direction, node, 1 FROM (SELECT DISTINCT 'out' AS direction, dst AS node FROM g, one WHERE src = entry UNION SELECT 'in', src FROM g, one WHERE dst = entry)
UNION ALL SELECT 'danger', '', count(DISTINCT api) FROM z JOIN kd USING (node) HAVING count(*) > 0"""
)
def call_dossier(spark, d):
    """What is known of one function, as one table: (part, item, n)."""
    f = _parsed(spark, d)
    e, n, s = _parts(spark, d)
    one = s.agg(F.min("entry")).first()[0]
    marks = f.select(_node(F.col("module"), F.col("function_name")).alias("node"), F.explode("dangerous").alias("api")).distinct()
    t = P.dossier(e, G.roots(e).select(F.col("node").alias("entry")), marks, one or "", 5)
    parts = [t["callers"].select(F.lit("caller").alias("part"), F.col("node").alias("item"), F.col("depth").cast("bigint").alias("n")) if one else t["callers"].limit(0).select(F.lit("").alias("part"), F.col("node").alias("item"), F.lit(0).cast("bigint").alias("n"))]
    parts.append(t["neighbours"].select(F.concat(F.lit("neighbour "), "direction").alias("part"), F.col("node").alias("item"), F.lit(1).cast("bigint").alias("n")))
    parts.append(t["danger"].select(F.lit("danger").alias("part"), F.lit("").alias("item"), F.col("apis").cast("bigint").alias("n")))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- imports and exports

#: Named functions stand for exports, every tenth one for a forwarder to a module of the same stem; external calls for imports.
_PE = (
    _G
    + r""", ex AS (SELECT module, function_name AS name, function_id AS ordinal, function_id % 10 = 0 AS forwarded, CASE WHEN function_id % 10 = 0 THEN regexp_extract(module, '^([^.]*)', 1) || '_x.dll' END AS to_module, CASE WHEN function_id % 10 = 0 THEN replace(function_name, '.', '_') END AS to_name FROM f WHERE function_name IS NOT NULL AND NOT starts_with(function_name, 'sub_')),
im AS (SELECT DISTINCT module, dst_module AS from_module, dst AS name, length(dst) % 2 = 0 AS delayed FROM ce WHERE coalesce(dst_module, '') <> '' AND dst_module <> module)"""
)


def _exports(spark, d) -> DataFrame:
    f = _parsed(spark, d).where("function_name IS NOT NULL AND NOT startswith(function_name, 'sub_')")
    forwarded = F.col("function_id") % 10 == 0
    to = F.when(forwarded, F.concat(F.regexp_extract("module", r"^([^.]*)", 1), F.lit("_x."), F.translate("function_name", ".", "_")))
    one = F.to_json(F.array(F.struct(F.col("function_name"), F.col("function_id").alias("ordinal"), forwarded.alias("is_forwarded"), to.alias("forwarded_to"))))
    return M.export_index(f.select("module", one.alias("exports")))


def _imports(spark, d) -> DataFrame:
    e = G.call_edges(_parsed(spark, d)).where("coalesce(dst_module, '') <> '' AND dst_module <> module").select("module", "dst_module", "dst").distinct()
    one = F.to_json(F.array(F.struct(F.col("dst_module").alias("module_name"), F.array(F.struct(F.col("dst").alias("function_name"), (F.length("dst") % 2 == 0).alias("is_delay_loaded"))).alias("functions"))))
    return M.import_index(e.select("module", one.alias("imports")))


@query("WITH" + _PE + " SELECT module, count(*) AS n, count(*) FILTER (forwarded) AS forwarded, min(to_module) AS to_module FROM ex GROUP BY 1")
def export_analysis(spark, d):
    return _exports(spark, d).groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.count_if("forwarded").alias("forwarded"), F.min("to_module").alias("to_module"))


@query("WITH" + _PE + " SELECT (SELECT count(*) FROM ex) AS exports, (SELECT count(*) FROM ex WHERE forwarded) AS forwarded, (SELECT count(DISTINCT lower(name)) FROM ex) AS export_names, (SELECT count(*) FROM im) AS imports, (SELECT count(DISTINCT lower(name)) FROM im) AS import_names, (SELECT count(DISTINCT (module, from_module)) FROM im) AS edges")
def index_summary(spark, d):
    return M.index_summary(_exports(spark, d), _imports(spark, d))


@query("WITH" + _PE + " SELECT module, from_module, count(DISTINCT lower(name)) AS names, bool_or(delayed) AS delayed FROM im GROUP BY 1, 2")
def import_dependencies(spark, d):
    return M.dependencies(_imports(spark, d))


@query(
    "WITH"
    + _PE
    + """, p AS (SELECT term AS prefix, min(sink_category) AS class FROM taxonomy WHERE kind = 'sink' GROUP BY 1), c AS (SELECT name, max_by(class, length(prefix)) AS class FROM (SELECT DISTINCT name FROM im) JOIN p ON starts_with(name, prefix) GROUP BY 1)
SELECT module, coalesce(class, 'other') AS class, count(DISTINCT im.name) AS names, count(DISTINCT from_module) AS from_modules, bool_or(delayed) AS delayed FROM im LEFT JOIN c ON c.name = im.name GROUP BY 1, 2"""
)
def import_analysis(spark, d):
    t = table(spark, d, "taxonomy").where("kind = 'sink'").groupBy(F.col("term").alias("prefix")).agg(F.min("sink_category").alias("class"))
    return M.import_analysis(_imports(spark, d), t)


@query(
    "WITH"
    + _PE
    + """, b AS (SELECT module, lower(function_name) AS n, min(function_id) AS function_id FROM f GROUP BY 1, 2)
SELECT ex.module, ex.name, CASE WHEN forwarded THEN 'forwarded' WHEN lower(name) IN ('dllgetclassobject', 'dllgetactivationfactory') THEN 'factory' ELSE 'plain' END AS kind, b.function_id FROM ex LEFT JOIN b ON b.module = ex.module AND b.n = lower(ex.name)"""
)
def export_functions(spark, d):
    return M.export_functions(_exports(spark, d), _parsed(spark, d).select("module", "function_name", "function_id"))


@query("WITH" + _PE + ", w AS (SELECT from_module AS b, module AS a FROM im GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1) SELECT DISTINCT ce.module AS src_module, ce.dst_module, ce.dst AS name FROM ce, w WHERE (ce.module = a AND ce.dst_module = b) OR (ce.module = b AND ce.dst_module = a)")
def shared_functions(spark, d):
    """What the two modules with most imports between them call in each other."""
    two = R.top(_imports(spark, d).groupBy("from_module", "module").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.col("from_module"), F.col("module")], 1).first()
    calls = G.call_edges(_parsed(spark, d)).select("module", "dst_module", "dst")
    return M.shared_functions(calls, two["module"], two["from_module"]) if two else calls.limit(0).toDF("src_module", "dst_module", "name")


@query("WITH" + _G + " SELECT module, src, dst FROM ce WHERE contains(lower(dst), 'vault')")
def references_to(spark, d):
    return M.calling_modules(G.call_edges(_parsed(spark, d)).select("module", "src", "dst", "dst_module"), "Vault").select("module", "src", "dst")


@query(
    "WITH"
    + _G
    + """, fan AS (SELECT dst AS node, count(DISTINCT src) AS callers FROM g GROUP BY 1), reg AS (SELECT src AS node, split_part(dst, '!', -1) AS api, 0 AS pos FROM g WHERE lower(split_part(dst, '!', -1)) LIKE '%next%'),
c AS (SELECT g.dst AS node, g.src AS by_, api, pos FROM g JOIN reg ON reg.node = g.src JOIN fan ON fan.node = g.dst WHERE callers <= 5 AND (regexp_matches(lower(g.dst), 'dispatch|call') OR callers <= 2))
SELECT node, arg_min(by_, (pos, api, by_)) AS "by", arg_min(api, (pos, api, by_)) AS api FROM c GROUP BY 1"""
)
def callback_candidates(spark, d):
    """Callees of functions that call a registration API, if few call them or their name hints at it."""
    e = _parts(spark, d)[0]
    api = F.element_at(F.split("dst", "!"), -1)
    return M.callbacks(e, e.where(F.contains(F.lower(api), F.lit("next"))).select(F.col("src").alias("node"), api.alias("api"), F.lit(0).alias("pos")), "dispatch|call")


@query(
    "WITH"
    + _DEF
    + """, t AS (SELECT module, function_id, unnest(dangerous) AS api, generate_subscripts(dangerous, 1) AS pos FROM f), c AS (SELECT t.*, x.sink_category AS category FROM t JOIN taxonomy x ON x.kind = 'sink' AND x.term = t.api),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY module, function_id, category ORDER BY pos) = 1)
SELECT module, function_id, category, api FROM k QUALIFY row_number() OVER (PARTITION BY module, function_id ORDER BY pos) <= 2"""
)
def one_api_per_category(spark, d):
    """The first API of each category, and of those the first two, for every function."""
    t = _parsed(spark, d).select("module", "function_id", F.posexplode("dangerous").alias("pos", "term"))
    x = table(spark, d, "taxonomy").where("kind = 'sink'").select("term", F.col("sink_category").alias("category"))
    return M.first_per_category(R.lookup_join(t, x, ["term"]), ["module", "function_id"], "category", ["pos"], 2).select("module", "function_id", "category", F.col("term").alias("api"))


@query("WITH" + _DEF + " SELECT module, CASE WHEN cardinality(ns) > 0 THEN 1 ELSE 0 END AS known, n FROM (SELECT module, list(DISTINCT function_name) FILTER (function_name IS NOT NULL) AS ns, count(*) AS n FROM f GROUP BY 1) ORDER BY n DESC, module LIMIT 20")
def largest_modules(spark, d):
    """The first modules by size under a cap, as a report of the largest ones."""
    g = _parsed(spark, d).groupBy("module").agg(F.count("function_name").alias("k"), F.count(F.lit(1)).alias("n"))
    return R.top(g.select("module", (F.col("k") > 0).cast("int").alias("known"), "n"), [F.desc("n"), F.col("module")], 20)


@query(
    "WITH"
    + _PE
    + """, c AS (SELECT module, function_id AS id, function_name AS name, coalesce(decompiled_code, '') <> '' AS code, len(dangerous) > 0 AS danger, function_signature AS sg, strings, dangerous, [y.function_name for y in outbound] AS apis, CASE WHEN vtable_contexts LIKE '[{%' THEN json_extract_string(vtable_contexts, '$[*].reconstructed_classes[*]') ELSE [] END AS classes FROM f),
xf AS (SELECT DISTINCT module, ordinal AS id FROM ex),
t AS (SELECT module, id, name, code, danger, dim, pos, unnest(texts) AS text, (module, id) IN (SELECT (module, id) FROM xf) AS exported, 1.0 AS factor, true AS app FROM c, LATERAL (VALUES ('name', 0, [name]), ('signature', 1, [sg]), ('string', 2, strings), ('api', 3, apis), ('dangerous', 4, dangerous), ('class', 5, classes)) AS v(dim, pos, texts)
 UNION ALL SELECT DISTINCT e.module, e.ordinal, e.name, c.code, c.danger, 'export', 6, e.name, true, 1.0, true FROM ex e JOIN c ON c.module = e.module AND c.id = e.ordinal UNION ALL SELECT DISTINCT module, -1, name, false, false, 'import', 7, name, false, 0.9, false FROM im),
q AS (SELECT *, CASE WHEN lower(text) = 'next' THEN 1.0 WHEN strpos(lower(text), 'next') = 1 THEN 0.85 WHEN strpos(lower(text), 'next') > 1 AND (substr(text, strpos(lower(text), 'next') - 1, 1) = '_' OR regexp_matches(substr(text, strpos(lower(text), 'next') - 1, 2), '^[a-z][A-Z]$')) THEN 0.75 WHEN strpos(lower(text), 'next') > 1 THEN 0.6 END AS quality FROM t WHERE text <> ''),
h AS (SELECT *, round(least(1.0, round(quality * 0.5 + CASE WHEN app THEN 0.15 ELSE 0 END + CASE WHEN code THEN 0.1 ELSE 0 END + CASE WHEN exported THEN 0.1 ELSE 0 END + CASE WHEN danger THEN 0.05 ELSE 0 END, 4)) * factor, 4) AS score, CASE WHEN id = -1 THEN lower(name) END AS k FROM q WHERE quality IS NOT NULL),
bb AS (SELECT module, id, k, dim, pos, min(name) AS name, max(score) AS score FROM h GROUP BY 1, 2, 3, 4, 5), gg AS (SELECT module, id, k, min(name) AS name, max(score) AS best, arg_max(dim, (score, -pos)) AS dim, count(*) AS dims FROM bb GROUP BY 1, 2, 3)
SELECT module, id, name, CAST(least(1.0, round(best + CASE WHEN dims > 1 THEN least(0.15, 0.05 * dims) ELSE 0 END, 4)) AS DOUBLE) AS score, dim, dims FROM gg"""
)
def search_all_dimensions(spark, d):
    """One text in all eight dimensions, exports and imports included."""
    ex = _exports(spark, d).select("module", "name", F.col("ordinal").alias("function_id"))
    c = S.with_module_texts(S.candidates(_parsed(spark, d)), ex, _imports(spark, d).select("module", "name"))
    return S.search(c, S.substring_quality(F.col("text"), "next"))
