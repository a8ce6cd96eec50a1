"""Queries over the star-schema tables: joins, windows, intervals, evidence merges, events and sessions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.columns import table
from factloom.operators import catalogs as C
from factloom.operators import relational as R
from factloom.operators import scoring as SC
from factloom.streaming import windows

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


@query(
    """SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity, round(sum(CAST(l_extendedprice * 100 AS BIGINT)) / 100.0, 2) AS price FROM lineitem GROUP BY 1, 2"""
)
def flag_totals(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return li.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.round(F.col("l_extendedprice") * 100).cast(BIG)) / 100.0, 2).alias("price"))


@query("SELECT event_type AS type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k FROM events GROUP BY 1")
def json_prop_stats(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast(BIG))
    return e.groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.sum("k").alias("total_k"))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    w = windows.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"])
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.col("event_type").alias("type"), "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s"""
)
def session_counts(spark, d):
    s = windows.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"])
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT user_id, event_type, max(value) AS best, count(*) AS n FROM events GROUP BY 1, 2")
def best_event_value(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("best"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def best_per_user(spark, d):
    return R.best_per_key(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")])


@query(
    """WITH t AS (SELECT user_id AS k, event_type AS sig, value AS score, event_id AS id FROM events), one AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY k, sig ORDER BY score DESC, id) = 1)
SELECT k, sig, score, id FROM one QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, id) <= 3"""
)
def top_distinct_events(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("sig"), F.col("value").alias("score"), F.col("event_id").alias("id"))
    return R.top_distinct(e, ["k"], "sig", [F.desc("score"), F.col("id")], 3)


@query(
    """WITH p AS (SELECT n_regionkey AS r, n_nationkey AS o, 3 AS size FROM nation), o AS (SELECT r, o, sum(size) OVER (PARTITION BY r ORDER BY o) - size AS lo, sum(size) OVER (PARTITION BY r ORDER BY o) AS hi FROM p),
i AS (SELECT n_regionkey AS r, s_suppkey AS item, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) - 1 AS pos FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT o.r AS region, o.o AS nation, i.item FROM o JOIN i ON o.r = i.r AND i.pos >= o.lo AND i.pos < o.hi"""
)
def interval_assignment(spark, d):
    n = table(spark, d, "nation")
    owners = n.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.lit(3).alias("size"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    items = s.select(F.col("n_regionkey").alias("region"), F.col("s_suppkey").alias("item"), (F.row_number().over(W.partitionBy("n_regionkey").orderBy("s_suppkey")) - 1).alias("pos"))
    return R.interval_assignment(owners, items, "region", "nation", "size", "pos").select("region", "nation", "item")


@query(
    """SELECT DISTINCT a.s_suppkey AS key, b.s_suppkey AS sibling FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey WHERE a.s_suppkey % 20 = 0"""
)
def shared_parent_siblings(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), "s_nationkey")
    return R.siblings(s, s.where("key % 20 = 0"), "key", ["s_nationkey"])


@query(
    """SELECT l_partkey AS type, l_linenumber AS offset_, arg_max(l_quantity, (l_returnflag = 'A', l_quantity)) AS size, array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS kinds, bool_or(l_returnflag = 'A') AS verified, count(*) AS n FROM lineitem GROUP BY 1, 2"""
)
def evidence_merge(spark, d):
    return _evidence(spark, d)


def _evidence(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("type"), F.col("l_linenumber").alias("offset_"), F.col("l_quantity").alias("size"), F.col("l_linestatus").alias("kind"), (F.col("l_returnflag") == "A").alias("verified"))
    return R.merge_fields(li, ["type", "offset_"], "size", "kind", "verified")


@query(
    """WITH m AS (SELECT l_partkey AS type, CAST(l_linenumber AS DOUBLE) * 20 AS offset_, arg_max(l_quantity, (l_returnflag = 'A', l_quantity)) AS size FROM lineitem GROUP BY 1, l_linenumber),
e AS (SELECT *, coalesce(max(offset_ + size) OVER (PARTITION BY type ORDER BY offset_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS end_ FROM m)
SELECT type, offset_, size, false AS is_gap FROM e UNION ALL SELECT type, end_, offset_ - end_, true FROM e WHERE offset_ > end_"""
)
def evidence_merge_gaps(spark, d):
    f = _evidence(spark, d).select("type", (F.col("offset_") * 20).alias("offset_"), "size")
    return R.with_gaps(f, "type", "offset_", "size")


@query(
    """SELECT o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 48) GROUP BY 1"""
)
def orders_with_large_lines(spark, d):
    keys = table(spark, d, "lineitem").where("l_quantity >= 48").select(F.col("l_orderkey").alias("o_orderkey"))
    o = R.in_keys(table(spark, d, "orders"), keys, ["o_orderkey"])
    return o.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query(
    """WITH b AS (SELECT c_custkey AS id, c_acctbal AS a, c_nationkey % 5 AS depth FROM customer), m AS (SELECT *, max(greatest(a, 0)) OVER () AS top FROM b)
SELECT id, least(1.0, round(0.25 * 0.5 + 0.30 * greatest(a, 0) / CASE WHEN top = 0 THEN 1 ELSE top END + 0.15 / (1 + depth), 6)) AS score FROM m"""
)
def composite_entry_score(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.greatest("c_acctbal", F.lit(0.0)).alias("danger"), (F.col("c_nationkey") % 5).alias("depth"))
    return SC.entry_score(c, "id", danger="danger", depth="depth", parameters=F.lit(0.5)).select("id", "score")


@query(
    """SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, round(greatest(0.1, 1 - 0.12 * (l_linenumber % 4)) / sqrt(greatest(l_linenumber, 1)), 6) AS trigger_, round(least(1.0, l_quantity / 50) / sqrt(greatest(l_linenumber, 1)), 6) AS taint FROM lineitem"""
)
def hop_decay_scores(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.round(SC.trigger(F.col("l_linenumber") % 4, F.col("l_linenumber")), 6).alias("trigger_"),
        F.round(SC.decayed(F.least(F.lit(1.0), F.col("l_quantity") / 50), F.col("l_linenumber")), 6).alias("taint"),
    )


@query(
    """SELECT source, link, count(*) AS n FROM (SELECT lower(trim(source)) AS source, unnest(list_distinct(regexp_extract_all(text, '([a-z]+\\.(?:dll|exe|sys|ocx))', 1))) AS link FROM documents) WHERE source IS NOT NULL GROUP BY 1, 2"""
)
def link_inverted_index(spark, d):
    doc = table(spark, d, "documents").select(F.lower(F.trim("source")).alias("source"), F.explode(C.mentions(F.col("text"), r"([a-z]+\.(?:dll|exe|sys|ocx))")).alias("link"))
    return doc.where("source IS NOT NULL").groupBy("source", "link").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT trim(s) AS line, count(*) AS refs, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) WHERE length(s) <= 500 AND trim(s) <> '' GROUP BY 1 HAVING count(*) > 1"""
)
def repeated_lines(spark, d):
    doc = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return R.string_inventory(doc, "lines", ["doc_id"]).where("refs > 1").select(F.col("string").alias("line"), "refs", F.col("owners").alias("docs"))


@query(
    """SELECT nation.n_name AS nation, region.r_name AS region, count(c_custkey) AS customers FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2"""
)
def nation_customers(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("c_custkey").alias("customers"))
    return n.join(c, "n_nationkey", "left").select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query(
    """SELECT c_mktsegment AS segment, n_regionkey AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""
)
def segment_pivot_long(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    wide = c.groupBy(F.col("c_mktsegment").alias("segment")).pivot("n_regionkey", [0, 1, 2, 3, 4]).agg(F.count(F.lit(1)))
    return wide.unpivot("segment", [str(i) for i in range(5)], "region", "n").where("n IS NOT NULL").select("segment", F.col("region").cast("int").alias("region"), "n")


@query(
    """SELECT o_orderstatus AS status, round(quantile_disc(o_totalprice, 0.5), 2) AS median FROM orders GROUP BY 1"""
)
def median_price(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice)"), 2).alias("median"))


@query("""SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 4) AS mean_norm FROM embeddings GROUP BY 1""")
def vector_label_norms(spark, d):
    e = table(spark, d, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(norm), 4).alias("mean_norm"))
