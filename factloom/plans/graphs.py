"""Graph and search queries: a part graph of consecutive order lines, and searches over functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.columns import table
from factloom.functions import scalar
from factloom.model import parsed_functions
from factloom.operators import graph as G
from factloom.operators import relational as R
from factloom.operators import search as S
from factloom.session import cut

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


_E = """e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst),
s AS (SELECT src AS entry FROM e GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1)"""


def part_edges(spark, d) -> DataFrame:
    """(src, dst): parts on consecutive lines of an order."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")  # noqa: E741
    nxt = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    e = l.withColumn("dst", nxt).where("dst IS NOT NULL AND l_partkey <> dst")
    return e.select(F.col("l_partkey").alias("src"), "dst").distinct()


def busiest(edges: DataFrame, n: int = 1) -> DataFrame:
    """(entry): the nodes with most successors; ties by number."""
    return edges.groupBy("src").count().orderBy(F.desc("count"), "src").limit(n).select(F.col("src").alias("entry"))


def _reach_sql(edge: str, depth: int, start: str = "s", extra: str = "") -> str:
    a, b = ("src", "dst") if edge == "out" else ("dst", "src")
    return f"""WITH RECURSIVE {_E}{extra}, r(entry, node, depth) AS (SELECT entry, entry, 0 FROM {start} UNION SELECT r.entry, e.{b}, r.depth + 1 FROM r JOIN e ON e.{a} = r.node WHERE r.depth < {depth}),
m AS (SELECT entry, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2)"""


@query(
    f"""WITH {_E}, g AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e), h AS (SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM g GROUP BY 1)
SELECT node, p_name AS name, n_in, n_out, n_in + n_out AS hub, CAST(row_number() OVER (ORDER BY n_in + n_out DESC, node) AS INTEGER) AS rank FROM h JOIN part ON p_partkey = node QUALIFY rank <= 20"""
)
def hub_rank(spark, d):
    deg = G.degrees(part_edges(spark, d)).withColumn("hub", F.col("n_in") + F.col("n_out"))
    top = R.top(deg, [F.desc("hub"), F.col("node")], 20)
    named = top.join(table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name")), "node")
    return named.withColumn("rank", F.row_number().over(W.orderBy(F.desc("hub"), "node")))  # 20 rows


@query(_reach_sql("out", 6) + " SELECT node, depth FROM m")
def bfs_depth(spark, d):
    e = cut(part_edges(spark, d))
    return G.reach(e, busiest(e), 6).select("node", "depth")


@query(_reach_sql("in", 4) + " SELECT node, depth FROM m")
def callers_depth(spark, d):
    e = cut(part_edges(spark, d))
    return G.callers(e, busiest(e), 4).select("node", "depth")


_MANY = ", s5 AS (SELECT src AS entry FROM e GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 5)"


@query(_reach_sql("out", 4, "s5", _MANY) + " SELECT depth, count(*) AS n FROM m GROUP BY 1")
def multi_source_depth_hist(spark, d):
    e = cut(part_edges(spark, d))
    return G.depth_histogram(G.reach(e, busiest(e, 5), 4))


@query(_reach_sql("out", 4, "s5", _MANY) + ", k AS (SELECT p_partkey AS node, p_brand AS api FROM part WHERE p_size >= 40) SELECT entry, count(*) AS refs, count(DISTINCT api) AS apis, min(depth) AS first_depth FROM m JOIN k USING (node) GROUP BY 1")
def danger_reach(spark, d):
    e = cut(part_edges(spark, d))
    marks = table(spark, d, "part").where("p_size >= 40").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("api"))
    return G.danger_reach(G.reach(e, busiest(e, 5), 4), marks)


@query(_reach_sql("out", 4, "s5", _MANY) + " SELECT node, arg_min(entry, (depth, entry)) AS source, min(depth) AS steps FROM m GROUP BY 1")
def nearest_entry(spark, d):
    e = cut(part_edges(spark, d))
    return G.nearest_source(e, busiest(e, 5), 3)


@query(_reach_sql("out", 6) + " SELECT CAST(max(depth) AS INTEGER) AS deepest, count(*) AS nodes FROM m")
def deepest_reach(spark, d):
    e = cut(part_edges(spark, d))
    return G.reach(e, busiest(e), 6).agg(F.max("depth").alias("deepest"), F.count(F.lit(1)).alias("nodes"))


@query(_reach_sql("out", 8) + ", t AS (SELECT max(depth) AS d FROM m), z AS (SELECT min(node) AS node FROM m, t WHERE depth = d) SELECT CAST(d AS BIGINT) + 1 AS nodes FROM t, z")
def shortest_path_len(spark, d):
    """Nodes on a shortest path from the busiest node to the furthest one within 8 steps."""
    e = cut(part_edges(spark, d))
    s = busiest(e).first()["entry"]
    far = G.reach(e, busiest(e), 8).orderBy(F.desc("depth"), "node").first()["node"]
    return G.shortest_path(e, s, far, 8).agg(F.count(F.lit(1)).alias("nodes"))


@query(f"WITH {_E} SELECT 'leaf' AS kind, dst AS node FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT 'root', src FROM e WHERE src NOT IN (SELECT dst FROM e)")
def leaf_root_nodes(spark, d):
    e = part_edges(spark, d)
    return G.leaves(e).select(F.lit("leaf").alias("kind"), "node").union(G.roots(e).select(F.lit("root"), "node"))


@query(f"WITH {_E}, g AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) * sum(o) AS BIGINT) AS score FROM g GROUP BY 1 HAVING sum(i) >= 3 AND sum(o) >= 3")
def bottlenecks(spark, d):
    return G.bottlenecks(part_edges(spark, d))


@query(f"WITH {_E}, n AS (SELECT p_partkey AS node FROM part UNION SELECT src FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM part) AS defined, (SELECT count(*) FROM e) / ((SELECT count(*) FROM part) * ((SELECT count(*) FROM part) - 1)) AS density")
def graph_stats(spark, d):
    return G.graph_stats(part_edges(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("node")))


@query(f"WITH {_E} SELECT node FROM (SELECT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT dst FROM e))")
def entry_nodes(spark, d):
    e = cut(part_edges(spark, d))
    return G.entries(e, table(spark, d, "part").select(F.col("p_partkey").alias("node")))


@query(f"WITH {_E} SELECT p_partkey AS node FROM part WHERE NOT EXISTS (SELECT 1 FROM e WHERE dst = p_partkey) AND NOT EXISTS (SELECT 1 FROM e WHERE src = p_partkey)")
def dead_nodes_anti(spark, d):
    e = cut(part_edges(spark, d))
    n = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return n.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


@query(f"WITH {_E} SELECT 'out' AS direction, dst AS node FROM e WHERE src = (SELECT entry FROM s) UNION SELECT 'in', src FROM e WHERE dst = (SELECT entry FROM s)")
def neighbours(spark, d):
    e = cut(part_edges(spark, d))
    return G.neighbours(e, busiest(e).first()["entry"])


@query(_reach_sql("out", 2) + " SELECT src, dst FROM e WHERE src IN (SELECT node FROM m) AND dst IN (SELECT node FROM m)")
def reach_subgraph(spark, d):
    e = cut(part_edges(spark, d))
    return G.subgraph(e, G.reach(e, busiest(e), 2))


@query(
    f"""WITH RECURSIVE {_E}, n AS (SELECT src, min(dst) AS dst FROM e GROUP BY 1), c AS (SELECT src AS start, 0 AS hop, src AS node, [src] AS path FROM n UNION ALL SELECT c.start, c.hop + 1, n.dst, list_append(c.path, n.dst) FROM c JOIN n ON n.src = c.node WHERE c.hop < 5 AND NOT list_contains(c.path, n.dst))
SELECT start, CAST(hop AS INTEGER) AS hop, node FROM c"""
)
def forwarder_chain(spark, d):
    e = cut(part_edges(spark, d))
    return G.follow_chain(e, e.select(F.col("src").alias("start")).distinct())


@query(
    f"""WITH RECURSIVE {_E}, p AS (SELECT [entry] AS path, entry AS node FROM s UNION ALL SELECT list_append(p.path, e.dst), e.dst FROM p JOIN e ON e.src = p.node WHERE len(p.path) < 4 AND NOT list_contains(p.path, e.dst)),
t AS (SELECT min(dst) AS target FROM e WHERE src = (SELECT entry FROM s)) SELECT array_to_string(path, '>') AS path FROM p WHERE node = (SELECT target FROM t) AND len(path) > 1 ORDER BY len(p.path), p.path LIMIT 100"""
)
def simple_paths(spark, d):
    e = cut(part_edges(spark, d))
    s = busiest(e).first()["entry"]
    t = e.where(F.col("src") == s).agg(F.min("dst")).first()[0]
    return G.simple_paths(e, s, t, 4).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


#: Every node with all that it leads to; the nodes of cycles.
_CLOSURE = """r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), loops AS (SELECT a AS node FROM r WHERE a = b)"""


@query(f"WITH RECURSIVE {_E}, {_CLOSURE} SELECT x.a AS node, max(greatest(x.a, x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1")
def scc_groups(spark, d):
    return G.components(part_edges(spark, d))


@query(
    f"""WITH RECURSIVE {_E}, {_CLOSURE}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), cyclic AS (SELECT node FROM loops UNION SELECT a FROM r JOIN loops ON b = node),
l(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT node FROM cyclic) UNION SELECT e.src, l.level + 1 FROM l JOIN e ON e.dst = l.node WHERE e.src NOT IN (SELECT node FROM cyclic))
SELECT node, CAST(-1 AS INTEGER) AS level FROM cyclic UNION ALL SELECT node, CAST(max(level) AS INTEGER) FROM l GROUP BY 1"""
)
def topo_levels(spark, d):
    return G.levels(part_edges(spark, d))


@query(
    """WITH p AS (SELECT DISTINCT s.s_nationkey AS a, c.c_nationkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer c ON c_custkey = o_custkey JOIN supplier s ON s_suppkey = l_suppkey WHERE s.s_nationkey <> c.c_nationkey)
SELECT a AS module, count(*) AS targets, CAST(count(*) FILTER (b > a) AS BIGINT) AS upward FROM p GROUP BY 1"""
)
def trust_transitions(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst_module"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("module"))
    pairs = li.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").select("module", "dst_module").where("module <> dst_module").distinct()
    ranks = table(spark, d, "nation").select(F.col("n_nationkey").alias("module"), F.col("n_nationkey").alias("rank"))
    t = G.trust_transitions(pairs, ranks)
    return t.groupBy("module").agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("transition") == "escalation").alias("upward"))


# ---------------------------------------------------------------- search

_C = """f AS (SELECT lower(module_id) AS module, *, CASE WHEN dangerous_api_calls LIKE '[%' THEN CAST(dangerous_api_calls::JSON AS VARCHAR[]) ELSE [] END AS dangerous, CASE WHEN string_literals LIKE '[%' THEN CAST(string_literals::JSON AS VARCHAR[]) ELSE [] END AS strings,
 CASE WHEN simple_outbound_xrefs LIKE '[{%' THEN CAST(json_extract_string(simple_outbound_xrefs, '$[*].function_name') AS VARCHAR[]) ELSE [] END AS apis, CASE WHEN vtable_contexts LIKE '[{%' THEN CAST(json_extract_string(vtable_contexts, '$[*].reconstructed_classes[*]') AS VARCHAR[]) ELSE [] END AS classes FROM module_functions),
c AS (SELECT module, function_id AS id, function_name AS name, coalesce(decompiled_code, '') <> '' AS has_code, len(dangerous) > 0 AS has_danger, dim, pos, unnest(texts) AS text FROM f, LATERAL (VALUES ('name', 0, [function_name]), ('signature', 1, [function_signature]), ('string', 2, strings), ('api', 3, apis), ('dangerous', 4, dangerous), ('class', 5, classes)) AS v(dim, pos, texts)),
t AS (SELECT * FROM c WHERE text IS NOT NULL AND text <> '')"""

_SCORE = """h AS (SELECT *, least(1.0, round(quality * 0.5 + 0.15 + CASE WHEN has_code THEN 0.1 ELSE 0 END + CASE WHEN has_danger THEN 0.05 ELSE 0 END, 4)) AS score FROM q WHERE quality IS NOT NULL),
b AS (SELECT module, id, dim, pos, min(name) AS name, max(score) AS score FROM h GROUP BY 1, 2, 3, 4),
g AS (SELECT module, id, min(name) AS name, max(score) AS best, arg_max(dim, (score, -pos)) AS dim, count(*) AS dims FROM b GROUP BY 1, 2)
SELECT module, id, name, CAST(least(1.0, round(best + CASE WHEN dims > 1 THEN least(0.15, 0.05 * dims) ELSE 0 END, 4)) AS DOUBLE) AS score, dim, dims FROM g"""


def _table(spark, d) -> DataFrame:
    return S.candidates(parsed_functions(table(spark, d, "module_functions")))


@query(
    f"""WITH {_C}, q AS (SELECT *, CASE WHEN lower(text) = 'token' THEN 1.0 WHEN strpos(lower(text), 'token') = 1 THEN 0.85 WHEN strpos(lower(text), 'token') > 1 AND (substr(text, strpos(lower(text), 'token') - 1, 1) = '_' OR regexp_matches(substr(text, strpos(lower(text), 'token') - 1, 2), '^[a-z][A-Z]$')) THEN 0.75 WHEN strpos(lower(text), 'token') > 1 THEN 0.6 END AS quality FROM t), {_SCORE}"""
)
def search_substring_score(spark, d):
    return S.search(_table(spark, d), S.substring_quality(F.col("text"), "token"))


@query(
    f"""WITH {_C}, q AS (SELECT *, CASE WHEN regexp_extract(text, '(?i)parse[a-z]+', 0) = '' THEN NULL WHEN length(regexp_extract(text, '(?i)parse[a-z]+', 0)) = length(text) THEN 1.0 ELSE least(0.99, 0.6 + 0.4 * (length(regexp_extract(text, '(?i)parse[a-z]+', 0)) / length(text))) END AS quality FROM t), {_SCORE}"""
)
def search_regex_score(spark, d):
    return S.search(_table(spark, d), S.regex_quality(F.col("text"), "parse[a-z]+"))


@query()
def search_fuzzy(spark, d):
    return S.search(_table(spark, d), S.fuzzy_quality("ParseHeader")(F.col("text")))


@query(
    """SELECT lower(module_id) AS module, function_id, CASE WHEN strpos(lower(function_signature), 'void *') > 0 THEN concat(CASE WHEN greatest(1, strpos(lower(function_signature), 'void *') - 20) > 1 THEN '...' ELSE '' END, substr(function_signature, greatest(1, strpos(lower(function_signature), 'void *') - 20), 66), CASE WHEN greatest(1, strpos(lower(function_signature), 'void *') - 20) + 65 < length(function_signature) THEN '...' ELSE '' END) END AS snippet FROM module_functions"""
)
def search_snippets(spark, d):
    f = table(spark, d, "module_functions")
    return f.select(F.lower("module_id").alias("module"), "function_id", S.snippet(F.col("function_signature"), "void *").alias("snippet"))


@query(
    """WITH n AS (SELECT lower(module_id) AS module, function_id AS id, function_name AS name FROM module_functions), w(wanted) AS (VALUES ('ondispatch'), ('7'), ('nosuchname'), ('parse')),
i AS (SELECT wanted, module, name, 'id' AS how FROM w JOIN n ON TRY_CAST(wanted AS BIGINT) = id UNION ALL SELECT wanted, module, name, 'exact' FROM w JOIN n ON lower(wanted) = lower(name)),
p AS (SELECT wanted, count(*) AS c, min(module) AS module, min(name) AS name FROM w JOIN n ON contains(lower(name), lower(wanted)) WHERE wanted NOT IN (SELECT wanted FROM i) GROUP BY 1)
SELECT * FROM i UNION ALL SELECT wanted, CASE WHEN c = 1 THEN module END, CASE WHEN c = 1 THEN name END, CASE WHEN c = 1 THEN 'partial' ELSE 'ambiguous' END FROM p"""
)
def resolve_names(spark, d):
    f = table(spark, d, "module_functions").select(F.lower("module_id").alias("module"), F.col("function_id").alias("id"), F.col("function_name").alias("name"))
    return S.resolve(f, spark.createDataFrame([("ondispatch",), ("7",), ("nosuchname",), ("parse",)], "wanted string"))


@query(
    """SELECT p_partkey, CASE WHEN p_name LIKE 'a%' AND length(p_name) > 3 AND p_name LIKE 'an%' THEN 'an' WHEN p_name LIKE 'a%' THEN 'a' WHEN p_name LIKE 'b%' THEN 'b' END AS class FROM part"""
)
def longest_prefix_class(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return p.select("p_partkey", scalar.longest_prefix(p, "p_name", [("a", "a"), ("an", "an"), ("b", "b")]).alias("class"))
