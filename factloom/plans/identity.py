"""Cleaned keys of findings, functions and classifications, shared by several queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.columns import computed
from factloom.functions.cleaning import IMPORT_PREFIXES, function_number, module_key, name_key, nearest_term, strip_blank, term_slug, vocabulary
from factloom.operators.skew import lookup_join
from factloom.session import cut


def function_names(functions: DataFrame) -> DataFrame:
    """One row per module and name, however written: module, name_key, function_name as stored, only_id.

    only_id is the function's id if no other function of the module has the name, else null.
    Of several spellings the one without an import mark, then the first, stands for all.
    """
    marked = F.lower(strip_blank(F.col("function_name"))).rlike("^(" + "|".join(IMPORT_PREFIXES) + ")")
    return (
        computed(functions, ["function_name", "function_id"], module=module_key(F.col("module_id")), name_key=name_key(F.col("function_name")), marked=marked)
        .where(F.col("module").isNotNull() & F.col("name_key").isNotNull())
        .groupBy("module", "name_key")
        .agg(
            F.min_by("function_name", F.struct("marked", "function_name")).alias("function_name"),
            F.when(F.min("function_id") == F.max("function_id"), F.min("function_id")).alias("only_id"),
        )
    )


def key_array(key: Column) -> Column:
    return F.split(strip_blank(key), r"\s*::\s*")


def key_parts(a: Column) -> dict[str, Column]:
    """The parts of a split key [module::]function::sink::source_category: function, sink, category (null where missing).

    Give the array as a column of its own (of key_array): it is used often.
    """
    n = F.size(a)
    led = (n >= 4) & F.get(a, F.lit(0)).rlike(r"(?i)\.[a-z0-9]{2,4}$")
    first = F.when(led, 2).otherwise(1)
    ok = n - first >= 2
    return {
        "function": F.when(ok, F.array_join(F.slice(a, first, F.greatest(n - 1 - first, F.lit(0))), "::")),
        "sink": F.when(ok, F.get(a, n - 2)),
        "category": F.when(ok, F.get(a, n - 1)),
    }


def identified(findings: DataFrame, functions: DataFrame, taxonomy: DataFrame, *carry: str) -> DataFrame:
    """Findings with the identity of what they state: (id, carried columns, module, function_id, sink, category).

    Rows whose module, function or terms can't be told are left out: they are the same as no other row.
    """
    keyed = F.coalesce(F.col("dedup_key"), F.lit("")).rlike(r"\S")
    raw = ["id", *carry, "function_id", "sink", "source_category"]
    rows = computed(findings, raw, __m=module_key(F.col("module")), __a=F.when(keyed, key_array(F.col("dedup_key"))))
    p, has = key_parts(F.col("__a")), F.col("__a").isNotNull()
    rows = computed(
        rows.where(F.col("__m").isNotNull()),
        ["id", *carry, "__m", "function_id"],
        __token=p["function"],
        __keyed=has,
        __ss=term_slug(F.when(has, p["sink"]).otherwise(F.col("sink"))),
        __cs=term_slug(F.when(has, p["category"]).otherwise(F.col("source_category"))),
    )
    rows = computed(rows, ["id", *carry, "__m", "__keyed", "__token", "function_id", "__ss", "__cs"], __number=function_number(F.col("__token")))
    fid, nk = F.when(F.col("__keyed"), F.col("__number")).otherwise(F.col("function_id")), F.when(F.col("__number").isNull(), name_key(F.col("__token")))
    rows = cut(computed(rows, ["id", *carry, "__m", "__ss", "__cs"], __fid=fid, __nk=nk).where("__ss <> '' AND __cs <> ''"))
    named = function_names(functions).where(F.col("only_id").isNotNull()).select(F.col("module").alias("__m"), F.col("name_key").alias("__nk"), "only_id")
    terms = cut(term_map(rows, {"sink": "__ss", "source_category": "__cs"}, taxonomy))
    for kind, slug, name in (("sink", "__ss", "__sink"), ("source_category", "__cs", "__cat")):
        rows = lookup_join(rows, terms.where(F.col("kind") == kind).select(F.col("slug").alias(slug), F.col("term").alias(name)), [slug], spread_by=["id"])
    out = lookup_join(rows, named, ["__m", "__nk"], "left", spread_by=["id"])
    return out.select(
        "id", *carry, F.col("__m").alias("module"), F.coalesce("__fid", "only_id").alias("function_id"), F.col("__sink").alias("sink"), F.col("__cat").alias("category")
    ).where(F.col("function_id").isNotNull())


def term_map(rows: DataFrame, slugs: dict[str, str], taxonomy: DataFrame) -> DataFrame:
    """(kind, slug, term) of each distinct slug that rows have of each kind of term and that means one; slugs: kind -> column.

    Edit distances are computed once per distinct slug, not once per row.
    """
    found = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("slug")) for k, c in slugs.items()])).alias("x")).select("x.*").distinct()
    # computed(), as the optimizer would else infer from a join on the slug that each row's own slug has to have a near term
    parts = [computed(found.where(F.col("kind") == k), ["kind", "slug"], term=nearest_term(F.col("slug"), vocabulary(taxonomy.where(F.col("kind") == k), "term"))) for k in slugs]
    return reduce(DataFrame.unionByName, parts).where(F.col("term").isNotNull())


IDENTITY = ("module", "function_id", "sink", "category")
