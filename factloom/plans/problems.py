"""Queries on skewed keys (p2) and nested records (p5), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.columns import computed, table, unit_number
from factloom.functions.cleaning import micros, module_key, name_key
from factloom.operators.nested import FINDING_CHILDREN, child_tables, triple_table
from factloom.operators.skew import fragment_replicate_join, grouped_by_shard
from factloom.plans.identity import function_names
from factloom.session import cut

#: The share of all rows beyond which a pair counts as hot.
HOT_SHARE = 0.01


def pair_results(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """Results per module and function_name: rows, scored rows, best and mean score, first and last creation.

    Rows without a module or a name, and names that no function of the module has, give no pair.
    Scores that are null or no number from 0 to 1 aren't scored.
    """
    rows = computed(findings, ["id"], module=module_key(F.col("module")), name_key=name_key(F.col("function_name")), score=unit_number(F.col("score")), created=micros(F.col("created_at")))
    names = function_names(functions).select("module", "name_key", "function_name")
    rows = rows.where(F.col("module").isNotNull() & F.col("name_key").isNotNull())
    joined = fragment_replicate_join(rows, names, ["module", "name_key"], keep_shard="shard", spread_by=["id"])
    out = grouped_by_shard(
        joined,
        ["module", "name_key", "function_name"],
        "shard",
        {"n": F.count(F.lit(1)), "n_scored": F.count("score"), "best": F.max("score"), "total": F.sum(F.col("score").cast("decimal(20,6)")), "first": F.min("created"), "last": F.max("created")},
        {"n": F.sum("n"), "n_scored": F.sum("n_scored"), "best": F.max("best"), "total": F.sum("total"), "first": F.min("first"), "last": F.max("last")},
    )
    return out.select("module", "function_name", "n", "n_scored", F.col("best").alias("best_score"), F.col("total").cast("double").alias("total_score"), F.col("first").alias("first_us"), F.col("last").alias("last_us"))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pair_results(table(spark, d, "findings"), table(spark, d, "module_functions"))


def hot_pairs(findings: DataFrame, functions: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """Pairs with more than the given share of all rows: (module, function_name)."""
    rows = computed(findings, ["id"], module=module_key(F.col("module")), name_key=name_key(F.col("function_name")))
    loads = cut(rows.groupBy("module", "name_key").agg(F.count(F.lit(1)).alias("load")))  # of all rows, those without a pair under null
    least = (loads.agg(F.sum("load")).first()[0] or 0) * share
    rows, loads = (t.where(F.col("module").isNotNull() & F.col("name_key").isNotNull()) for t in (rows, loads))
    names = function_names(functions).select("module", "name_key", "function_name")
    joined = fragment_replicate_join(rows, names, ["module", "name_key"], loads=loads, keep_shard="shard", spread_by=["id"])
    out = grouped_by_shard(joined, ["module", "name_key", "function_name"], "shard", {"n": F.count(F.lit(1))}, {"n": F.sum("n")})
    return out.where(F.col("n") > least).select("module", "function_name")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_pairs(table(spark, d, "findings"), table(spark, d, "module_functions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return child_tables(table(spark, d, "findings"), "id", FINDING_CHILDREN)


def p5_guards(spark: SparkSession, d: str) -> DataFrame:
    """The guard table with its scalar fields as columns."""
    rows = child_tables(table(spark, d, "findings"), "id", {"guards_json": FINDING_CHILDREN["guards_json"]}, fields=True)
    f = lambda k: F.try_element_at("fields", F.lit(k))
    return rows.where(F.col("child") == "guard").select("id", "pos", f("guard_type").alias("guard_type"), f("attacker_controllable").alias("attacker_controllable"), f("bypass_difficulty").alias("bypass_difficulty"), F.coalesce(f("description"), f("")).alias("description"))


def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    """All child tables with their fields, a row per field: (id, child, parent_pos, pos, field, value); a lone value's field is ''."""
    rows = child_tables(table(spark, d, "findings"), "id", FINDING_CHILDREN, fields=True)
    return rows.select("id", "child", "parent_pos", "pos", F.explode("fields").alias("field", "value"))


def p5_steps(spark: SparkSession, d: str) -> DataFrame:
    """The steps of paths with how many sites each has, joined by the parent's place."""
    rows = child_tables(table(spark, d, "findings"), "id", {"path_json": FINDING_CHILDREN["path_json"]}, fields=True)
    name = F.coalesce(F.try_element_at("fields", F.lit("function")), F.try_element_at("fields", F.lit("")))
    at = F.when(F.col("child") == "step", F.col("pos")).otherwise(F.col("parent_pos"))
    steps = rows.groupBy("id", at.alias("pos")).agg(F.max(F.when(F.col("child") == "step", name)).alias("function"), F.count_if(F.col("child") == "site").alias("sites"), F.bool_or(F.col("child") == "step").alias("there"))
    return steps.where("there").select("id", "pos", "function", "sites")


def p5_triples(spark: SparkSession, d: str) -> DataFrame:
    """Every leaf of the extra texts: (id, path, ordinals, value)."""
    t = triple_table(table(spark, d, "findings"), "id", "extra_json")
    return t.select("id", "path", F.array_join(F.transform("ordinals", lambda x: x.cast("string")), ".").alias("ordinals"), "value")


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs, "p5_found": p5_found, "p5_guards": p5_guards, "p5_fields": p5_fields, "p5_steps": p5_steps, "p5_triples": p5_triples}

_MODULE = r"nullif(lower(regexp_extract(trim(module, e' \t\n\r '), '([^/\\]*)$', 1)), '')"
_NAME = "nullif(regexp_replace(lower(trim(function_name)), '^(__imp_|_imp_|j_|cs:)', ''), '')"
_INSTANT = """CASE WHEN regexp_full_match(trim({c}), '-?\\d+(\\.\\d+)?') THEN make_timestamp(CAST(CAST(trim({c}) AS DECIMAL(20,6)) * 1000000 AS BIGINT))
 WHEN regexp_matches(trim({c}), '([zZ]|[+-]\\d{{2}}:\\d{{2}})$') THEN CAST(TRY_CAST(trim({c}) AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP)
 ELSE TRY_CAST(trim({c}) AS TIMESTAMP) END"""

_PAIRS = f"""
WITH names AS (SELECT lower(module_id) AS module, lower(function_name) AS name_key, min(function_name) AS function_name FROM module_functions GROUP BY 1, 2),
rows_ AS (SELECT {_MODULE} AS module, {_NAME} AS name_key, CASE WHEN score >= 0 AND score <= 1 THEN score END AS score, {_INSTANT.format(c="created_at")} AS created FROM findings)
SELECT module, n.function_name, count(*) AS n, count(score) AS n_scored, max(score) AS best_score, CAST(sum(CAST(score AS DECIMAL(20,6))) AS DOUBLE) AS total_score, epoch_us(min(created)) AS first_us, epoch_us(max(created)) AS last_us
FROM rows_ JOIN names n USING (module, name_key) GROUP BY ALL
"""



def _elements(name: str, of: str, keep: str, array: str) -> str:
    """SQL of (id, up, pos, x): the elements of a JSON value `array` of each row of `of`, whose column `keep` becomes up."""
    return f"""{name}0 AS (SELECT id, {keep} AS up, {array} AS j FROM {of}), {name}1 AS (SELECT id, up, CASE WHEN json_type(j) = 'VARCHAR' AND regexp_matches(j->>'$', '^\\s*[\\[{{]') AND json_valid(j->>'$') THEN (j->>'$')::JSON ELSE j END AS j FROM {name}0 WHERE j IS NOT NULL AND json_type(j) <> 'NULL'),
{name}2 AS (SELECT id, up, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE [j] END AS xs FROM {name}1), {name}3 AS (SELECT id, up, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS pos FROM {name}2),
{name}4 AS (SELECT id, up, pos, CASE WHEN json_type(x) = 'VARCHAR' AND regexp_matches(x->>'$', '^\\s*[\\[{{]') AND json_valid(x->>'$') THEN (x->>'$')::JSON ELSE x END AS x FROM {name}3),
{name} AS (SELECT id, up, CAST(pos AS INTEGER) AS pos, x FROM {name}4 WHERE x IS NOT NULL AND json_type(x) <> 'NULL' AND NOT (json_type(x) = 'OBJECT' AND json_exists(x, '$._truncated')))"""


def _whole(name: str, column: str) -> str:
    """SQL of (id, j): whole JSON texts of a column, JSON in strings read as JSON; strings cut off inside are none."""
    read = lambda n, of: f"""{n} AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(j->>'$') THEN (j->>'$')::JSON ELSE j END AS j FROM {of})"""
    return f"""{name}_a AS (SELECT id, {column}::JSON AS j FROM findings WHERE {column} IS NOT NULL AND json_valid({column})), {read(name + "_b", name + "_a")}, {read(name + "_c", name + "_b")},
{name} AS (SELECT * FROM {name}_c WHERE json_type(j) <> 'NULL' AND NOT (json_type(j) = 'VARCHAR' AND regexp_matches(j->>'$', '^\\s*[\\[{{]')))"""


_CHILDREN = ", ".join(
    [
        _whole("gj", "guards_json"), _whole("pj", "path_json"), _whole("xj", "extra_json"),
        _elements("guard", "gj", "-1", "j"), _elements("chk", "guard", "pos", "CASE WHEN json_exists(x, '$.checks') THEN x->'$.checks' ELSE x->'$.conditions' END"),
        _elements("step", "pj", "-1", "j"), _elements("site", "step", "pos", "x->'$.sites'"),
        _elements("affected", "xj", "-1", "j->'$.affected_functions'"), _elements("mitigation", "xj", "-1", "j->'$.mitigations_present'"),
        "flow AS (SELECT id, CASE WHEN json_type(f) = 'VARCHAR' AND regexp_matches(f->>'$', '^\\s*[\\[{]') AND json_valid(f->>'$') THEN (f->>'$')::JSON ELSE f END AS f FROM (SELECT id, j->'$.data_flow' AS f FROM xj))",
        _elements("hop", "flow", "-1", "f->'$.hops'"), _elements("ref", "hop", "pos", "x->'$.refs'"),
    ]
)
_P5 = f"WITH {_CHILDREN} " + " UNION ALL ".join(f"SELECT id, '{c}' AS child, CAST(up AS INTEGER) AS parent_pos, pos FROM {t}" for c, t in [("guard", "guard"), ("check", "chk"), *[(x, x) for x in ("step", "site", "affected", "mitigation", "hop", "ref")]])

ORACLES = {
    "p5_found": _P5,
    "p5_steps": f"WITH {_CHILDREN}, n AS (SELECT id, up, count(*) AS sites FROM site GROUP BY 1, 2) SELECT step.id, step.pos, CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.function' ELSE x->>'$' END AS function, coalesce(sites, 0) AS sites FROM step LEFT JOIN n ON n.id = step.id AND n.up = step.pos",
    "p5_guards": f"WITH {_CHILDREN} SELECT id, pos, " + ", ".join(f"CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.{k}' END AS {k}" for k in ("guard_type", "attacker_controllable", "bypass_difficulty")) + ", CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.description' ELSE x->>'$' END AS description FROM guard",
    "p2_pairs": _PAIRS,
    "p2_found": f"SELECT module, function_name FROM ({_PAIRS}) WHERE n > (SELECT 0.01 * count(*) FROM findings)",
}
