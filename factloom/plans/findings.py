"""Queries over findings, their runs and the store's operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.columns import computed, table, unit_number
from factloom.functions import scalar
from factloom.functions.cleaning import micros, module_key, slug
from factloom.operators import relational as R
from factloom.operators import store
from factloom.operators.nested import difficulties, path_nodes, text_arrays

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


def _us(c: str) -> str:
    return f"""CASE WHEN regexp_full_match(trim({c}), '-?\\d+(\\.\\d+)?') THEN CAST(CAST(trim({c}) AS DECIMAL(20,6)) * 1000000 AS BIGINT)
 WHEN regexp_matches(trim({c}), '([zZ]|[+-]\\d{{2}}:\\d{{2}})$') THEN epoch_us(TRY_CAST(trim({c}) AS TIMESTAMPTZ)) ELSE epoch_us(TRY_CAST(trim({c}) AS TIMESTAMP)) END"""


_VALID = "CASE WHEN score >= 0 AND score <= 1 THEN score END"
_MODULE = r"nullif(lower(regexp_extract(trim(module), '([^/\\]*)$', 1)), '')"


def findings(spark, d) -> DataFrame:
    return table(spark, d, "findings")


def scored(spark, d) -> DataFrame:
    f = findings(spark, d)
    return computed(f, ["id", "severity", "source_type", "sink_category", "exploitability_rating"], module=module_key(F.col("module")), score=unit_number(F.col("score")), exploit=unit_number(F.col("exploitability_score")))


@query(
    f"""WITH f AS (SELECT coalesce(severity, 'unknown') AS severity, coalesce(source_type, 'unknown') AS source_type, {_VALID} AS score FROM findings)
SELECT 'all' AS level, NULL AS value, count(*) AS n, max(score) AS best FROM f UNION ALL SELECT 'severity', severity, count(*), max(score) FROM f GROUP BY 2 UNION ALL SELECT 'source_type', source_type, count(*), max(score) FROM f GROUP BY 2"""
)
def store_summary_sets(spark, d):
    return R.two_way_summary(scored(spark, d), "severity", "source_type", "score")


@query(
    f"""SELECT id, {_VALID} AS score FROM findings WHERE upper(trim(severity)) IN ('HIGH', 'CRITICAL') AND {_VALID} >= 0.8 ORDER BY score DESC, id LIMIT 200"""
)
def severity_at_least(spark, d):
    f = scored(spark, d).where((scalar.severity_rank(F.col("severity")) >= 3) & (F.col("score") >= 0.8)).select("id", "score")
    return R.top(f, [F.desc("score"), F.col("id")], 200)


@query(
    f"""SELECT CASE WHEN s >= 0.75 THEN 'CRITICAL' WHEN s >= 0.55 THEN 'HIGH' WHEN s >= 0.35 THEN 'MEDIUM' WHEN s IS NOT NULL THEN 'LOW' END AS band, count(*) AS n FROM (SELECT {_VALID} AS s FROM findings) GROUP BY 1"""
)
def score_bands(spark, d):
    return scored(spark, d).groupBy(scalar.severity(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH dom(severity) AS (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('NONE')) SELECT dom.severity, count(f.severity) AS n FROM dom LEFT JOIN findings f ON f.severity = dom.severity GROUP BY 1"""
)
def findings_by_severity(spark, d):
    return R.domain_counts(findings(spark, d), "severity", ("CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE"))


@query(
    f"""SELECT {_MODULE} AS module, count(*) AS n, count({_VALID}) AS n_scored, max({_VALID}) AS best FROM findings GROUP BY 1"""
)
def findings_per_module(spark, d):
    return scored(spark, d).groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"), F.max("score").alias("best"))


@query(
    f"""WITH f AS (SELECT id, coalesce(CASE WHEN exploitability_score >= 0 AND exploitability_score <= 1 THEN exploitability_score END, {_VALID}) AS s, CASE upper(trim(severity)) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS r FROM findings)
SELECT id, s AS rank_score, row_number() OVER (ORDER BY s DESC NULLS LAST, r DESC, id) AS place FROM f"""
)
def rank_findings(spark, d):
    f = scored(spark, d).select("id", F.coalesce("exploit", "score").alias("rank_score"), scalar.severity_rank(F.col("severity")).alias("r"))
    return R.ranked(f, [F.desc_nulls_last("rank_score"), F.desc("r"), F.col("id")], "place").select("id", "rank_score", "place")


def _shapes(column: str, *more: str) -> str:
    """SQL of (id, x): each element of a JSON text's array; a lone value is an array of one, JSON in a string is read as JSON, nulls and markers of cut arrays are no elements."""
    texts = ", ".join(["id", *more])
    read = lambda n, of: f"""{n} AS (SELECT {texts}, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(j->>'$') THEN (j->>'$')::JSON ELSE j END AS j FROM {of})"""
    return f"""j0 AS (SELECT {texts}, {column}::JSON AS j FROM findings WHERE {column} IS NOT NULL AND json_valid({column})), {read("j1", "j0")}, {read("j2", "j1")},
whole AS (SELECT {texts}, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE [j] END AS xs FROM j2 WHERE json_type(j) <> 'NULL' AND NOT (json_type(j) = 'VARCHAR' AND regexp_matches(j->>'$', '^\\s*[\\[{{]'))),
unwrapped AS (SELECT {texts}, list_transform(xs, lambda x: CASE WHEN json_type(x) = 'VARCHAR' AND regexp_matches(x->>'$', '^\\s*[\\[{{]') AND json_valid(x->>'$') THEN (x->>'$')::JSON ELSE x END) AS xs FROM whole),
shaped AS (SELECT {texts}, list_filter(xs, lambda x: x IS NOT NULL AND json_type(x) <> 'NULL' AND NOT (json_type(x) = 'OBJECT' AND json_exists(x, '$._truncated'))) AS xs FROM unwrapped)"""


_PATHS = f"""{_shapes("path_json", "dedup_key", "score")}, p AS (SELECT id, trim(dedup_key) AS k, score, substr(sha256(array_to_string(list_sort(list_transform(xs, lambda x: coalesce(x->>'$.function', x->>'$'))), '|')), 1, 16) AS sig
 FROM shaped WHERE coalesce(trim(dedup_key), '') <> '' AND score >= 0 AND score <= 1)"""


@query(
    f"""WITH {_PATHS}, one AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY k, sig ORDER BY score DESC, id) = 1)
SELECT k AS dedup_key, sig AS signature, id, score FROM one QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, id) <= 3"""
)
def dedup_top3_paths(spark, d):
    """Per key the three best rows of different paths, whatever the JSON shape of a path; paths without nodes are one path."""
    f = computed(findings(spark, d), ["id", "path_json"], dedup_key=F.trim("dedup_key"), score=unit_number(F.col("score")))
    f = text_arrays(f.where("dedup_key <> '' AND score IS NOT NULL"), "path_json", "path", path_nodes)
    f = computed(f, ["id", "dedup_key", "score"], signature=store.path_signature(F.col("path")))
    return store.top_paths(f, "dedup_key", "signature", "score", "id")


#: The instant that parts the stored findings from the incoming ones.
SPLIT = 1_751_328_000_000_000

_SIDE = f"""s AS (SELECT trim(dedup_key) AS k, coalesce({_VALID}, 0.0) AS score, severity, verification_status AS status, id, {_us('created_at')} AS us FROM findings WHERE coalesce(trim(dedup_key), '') <> ''),
o AS (SELECT k, arg_max(score, (score, -id)) AS score, arg_max(struct_pack(v := severity), (score, -id)).v AS severity, arg_max(struct_pack(v := status), id).v AS status FROM s WHERE us IS NULL OR us < {SPLIT} GROUP BY 1),
n AS (SELECT k, arg_max(score, (score, -id)) AS score, arg_max(struct_pack(v := severity), (score, -id)).v AS severity, arg_max(struct_pack(v := status), id).v AS status FROM s WHERE us >= {SPLIT} GROUP BY 1)"""


@query(
    f"""WITH {_SIDE} SELECT coalesce(n.k, o.k) AS dedup_key, CASE WHEN n.k IS NOT NULL AND (o.k IS NULL OR n.score > o.score) THEN n.score ELSE o.score END AS score,
 CASE WHEN n.k IS NOT NULL AND (o.k IS NULL OR n.score > o.score) THEN n.severity ELSE o.severity END AS severity, CASE WHEN n.k IS NOT NULL THEN n.status ELSE o.status END AS status FROM o FULL JOIN n ON o.k = n.k"""
)
def finding_upsert(spark, d):
    f = findings(spark, d)
    f = computed(f, ["id", "severity", F.col("verification_status").alias("status")], dedup_key=F.trim("dedup_key"), score=F.coalesce(unit_number(F.col("score")), F.lit(0.0)), us=micros(F.col("created_at"))).where("dedup_key <> ''")
    side = lambda c: store.folded(f.where(c).select("dedup_key", "score", "severity", "status", "id"), "dedup_key", "score", "id", ["status"]).drop("id")
    return store.upsert(side(f"us IS NULL OR us < {SPLIT}"), side(f"us >= {SPLIT}"), "dedup_key", "score", ["status"])  # a row without an instant is an old one


@query(f"SELECT count(*) AS kept, (SELECT count(*) FROM findings WHERE {_us('updated_at')} < {SPLIT}) AS removed FROM findings WHERE NOT coalesce({_us('updated_at')} < {SPLIT}, false)")
def purge_old(spark, d):
    f = computed(findings(spark, d), [], us=micros(F.col("updated_at")))
    gone = F.coalesce(F.col("us") < SPLIT, F.lit(False))
    return f.agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("removed"))


@query(
    f"""SELECT dedup_key, id FROM (SELECT trim(dedup_key) AS dedup_key, id, {_us('updated_at')} AS us FROM findings WHERE coalesce(trim(dedup_key), '') <> '') QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY us DESC NULLS LAST, id DESC) = 1"""
)
def latest_per_key(spark, d):
    f = computed(findings(spark, d), ["id"], dedup_key=F.trim("dedup_key"), us=micros(F.col("updated_at"))).where("dedup_key <> ''")
    return store.latest(f, ["dedup_key"], "us", "id").select("dedup_key", "id")


@query(
    f"""WITH {_shapes("guards_json")}, g AS (SELECT id, list_transform(list_filter(xs, lambda x: json_type(x) = 'OBJECT' AND json_exists(x, '$.bypass_difficulty')), lambda x: CASE x->>'$.bypass_difficulty' WHEN 'hard' THEN 0.4 WHEN 'medium' THEN 0.2 ELSE 0.1 END) AS w FROM shaped)
SELECT id, CAST(round(greatest(0.0, 1.0 - coalesce(list_sum(w), 0)), 1) AS DOUBLE) AS bypass FROM g"""
)
def guard_bypass(spark, d):
    f = text_arrays(findings(spark, d).select("id", "guards_json"), "guards_json", "hard", difficulties)
    return f.select("id", F.round(scalar.bypass(F.col("hard")), 1).alias("bypass"))


@query(
    """SELECT regexp_replace(lower(verification_status), '[^a-z]', '', 'g') AS status, count(*) AS n FROM findings WHERE regexp_replace(lower(verification_status), '[^a-z]', '', 'g') IN (SELECT regexp_replace(lower(status), '[^a-z]', '', 'g') FROM status_trust) GROUP BY 1"""
)
def known_statuses(spark, d):
    known = table(spark, d, "status_trust").select(slug(F.col("status")).alias("status"))
    return R.lookup_join(findings(spark, d).select(slug(F.col("verification_status")).alias("status")), known, ["status"], "left_semi").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT lower(trim(r.run_id)) AS run, count(f.id) AS findings, CASE WHEN any_value(r.status) IS NULL THEN 'unknown' ELSE any_value(r.status) END AS status FROM scan_runs r LEFT JOIN findings f ON lower(trim(f.run_id)) = lower(trim(r.run_id)) GROUP BY 1"""
)
def findings_per_run(spark, d):
    f = findings(spark, d).groupBy(F.lower(F.trim("run_id")).alias("run")).agg(F.count("id").alias("findings"))
    r = table(spark, d, "scan_runs").select(F.lower(F.trim("run_id")).alias("run"), F.coalesce("status", F.lit("unknown")).alias("status"))
    return r.join(f, "run", "left").fillna(0, ["findings"])


@query(
    """SELECT run_id, module, row_number() OVER (ORDER BY finished_at DESC NULLS LAST, started_at DESC NULLS LAST, run_id DESC) AS place FROM scan_runs"""
)
def run_listing(spark, d):
    r = table(spark, d, "scan_runs").select("run_id", "module", "started_at", "finished_at")
    return R.ranked(r, [F.desc_nulls_last("finished_at"), F.desc_nulls_last("started_at"), F.desc("run_id")], "place").select("run_id", "module", "place")


@query(
    """SELECT module, CASE WHEN count(*) FILTER (status = 'error' OR status = 'failed') > 0 THEN 'error' WHEN count(*) FILTER (status IN ('complete', 'ok', 'success')) = count(*) THEN 'ok' WHEN count(*) FILTER (status IN ('in_progress', 'pending', 'running')) > 0 THEN 'in_progress' ELSE 'partial' END AS state, count(*) AS runs FROM scan_runs GROUP BY 1"""
)
def run_roll_up(spark, d):
    is_ = lambda *v: F.count_if(F.col("status").isin(*v))
    g = table(spark, d, "scan_runs").groupBy("module").agg(F.count(F.lit(1)).alias("runs"), is_("error", "failed").alias("e"), is_("complete", "ok", "success").alias("k"), is_("in_progress", "pending", "running").alias("o"))
    return g.select("module", R.run_status(F.col("runs"), F.col("e"), F.col("k"), F.col("o")).alias("state"), "runs")


@query(
    f"""WITH m AS (SELECT {_MODULE} AS module, {_VALID} AS s FROM findings) SELECT module, avg_score, round(avg_score / max(avg_score) OVER (), 6) AS share FROM (SELECT module, round(avg(s), 6) AS avg_score FROM m WHERE module IS NOT NULL AND s IS NOT NULL GROUP BY 1)"""
)
def module_score_share(spark, d):
    g = scored(spark, d).where("module IS NOT NULL AND score IS NOT NULL").groupBy("module").agg(F.round(F.avg("score"), 6).alias("avg_score"))
    top = g.agg(F.max("avg_score").alias("m"), F.lit(1).alias("k"))
    return g.withColumn("k", F.lit(1)).join(F.broadcast(top), "k").select("module", "avg_score", F.round(F.col("avg_score") / F.col("m"), 6).alias("share"))


@query(
    f"""SELECT coalesce(exploitability_rating, 'none') AS rating, {_MODULE} IS NULL AS no_module, count(*) AS n, count(DISTINCT {_MODULE}) AS modules FROM findings GROUP BY 1, 2"""
)
def rating_counts(spark, d):
    f = scored(spark, d)
    return f.groupBy(F.coalesce("exploitability_rating", F.lit("none")).alias("rating"), F.col("module").isNull().alias("no_module")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("module").alias("modules"))


@query(
    f"""WITH f AS (SELECT {_MODULE} AS module, sink_category, {_VALID} AS s FROM findings), g AS (SELECT module, sink_category AS category, count(*) AS n FROM f WHERE module IS NOT NULL AND sink_category IS NOT NULL AND s >= 0.5 GROUP BY 1, 2)
SELECT module, category, n, CAST(row_number() OVER (PARTITION BY module ORDER BY n DESC, category) AS INTEGER) AS place FROM g QUALIFY place <= 2"""
)
def top_categories(spark, d):
    g = scored(spark, d).where("module IS NOT NULL AND sink_category IS NOT NULL AND score >= 0.5").groupBy("module", F.col("sink_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("module").orderBy(F.desc("n"), "category"))).where("place <= 2")


@query(
    """WITH t AS (SELECT primary_category AS c, interest_score AS i FROM classification_results) SELECT count(*) AS records, count(*) FILTER (i BETWEEN 7 AND 10) AS interesting, count(*) FILTER (i IS NULL OR i < 0 OR i > 10) AS unscored, count(DISTINCT c) AS spellings FROM t"""
)
def classification_overview(spark, d):
    i = F.col("interest_score")
    return table(spark, d, "classification_results").agg(F.count(F.lit(1)).alias("records"), F.count_if(i.between(7, 10)).alias("interesting"), F.count_if(i.isNull() | (i < 0) | (i > 10)).alias("unscored"), F.count_distinct("primary_category").alias("spellings"))


@query(
    """SELECT k AS category, count(*) AS n, round(max(v), 4) AS best FROM (SELECT unnest(map_keys(scores)) AS k, unnest(map_values(scores)) AS v FROM classification_results) GROUP BY 1"""
)
def category_scores(spark, d):
    e = table(spark, d, "classification_results").select(F.explode("scores").alias("category", "v"))
    return e.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("v"), 4).alias("best"))


@query(
    """WITH m AS (SELECT module, function_id, scores, map_keys(scores) AS ks, map_values(scores) AS vs, classified_at FROM classification_results WHERE cardinality(scores) > 0)
SELECT module, function_id, epoch_us(classified_at) AS at_us, list_max(vs) AS top FROM m"""
)
def top_class_score(spark, d):
    c = table(spark, d, "classification_results").where(F.size("scores") > 0)
    return c.select("module", "function_id", F.unix_micros("classified_at").alias("at_us"), F.array_max(F.map_values("scores")).alias("top"))


@query(
    """SELECT s AS secondary, count(*) AS n FROM (SELECT unnest(CASE WHEN len(coalesce(secondary_categories, [])) = 0 THEN ['(none)'] ELSE secondary_categories END) AS s FROM classification_results) GROUP BY 1"""
)
def secondary_groups(spark, d):
    c = table(spark, d, "classification_results")
    return R.group_multi(c, F.col("secondary_categories"), "(none)", "secondary").groupBy("secondary").agg(F.count(F.lit(1)).alias("n"))
