"""Indexes of functions: groups by library, statistics, noise, searches, and modules found by name or path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.cleaning import module_key
from factloom.operators.search import fuzzy_quality, regex_quality, substring_quality
from factloom.sources.readers import by_library

APP = "(application)"


def library_groups(index: DataFrame) -> DataFrame:
    """(library, n, with_code) of an index (library, has_decompiled); functions of no library are the application's."""
    return index.groupBy(F.coalesce("library", F.lit(APP)).alias("library")).agg(F.count(F.lit(1)).alias("n"), F.count_if("has_decompiled").alias("with_code"))


def index_stats(index: DataFrame) -> DataFrame:
    """(module, total, app, library, decompiled, libraries, files): one row per module; libraries is how many, files how many different ones."""
    lib = F.col("library").isNotNull()
    f = index.withColumn("__f", F.explode_outer("files"))
    files = f.groupBy("module").agg(F.count_distinct("__f").alias("files"))
    s = index.groupBy("module").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~lib).alias("app"), F.count_if(lib).alias("library"), F.count_if("has_decompiled").alias("decompiled"), F.count_distinct("library").alias("libraries")
    )
    return s.join(files, "module")


def noise_ratio(index: DataFrame) -> DataFrame:
    """(module, noise): the share of library functions, to 4 decimals."""
    return index.groupBy("module").agg(F.round(F.count_if(F.col("library").isNotNull()) / F.count(F.lit(1)), 4).alias("noise"))


def search_index(index: DataFrame, pattern: str, mode: str = "substring", library: str | None = None, app_only: bool = False, lib_only: bool = False, threshold: float = 0.6) -> DataFrame:
    """Entries whose name matches, by substring or regular expression in any case, or nearly ('fuzzy'), among those of a library, the application or any library."""
    kinds = {"substring": lambda c: substring_quality(c, pattern), "regex": lambda c: regex_quality(c, pattern), "fuzzy": lambda c: fuzzy_quality(pattern, threshold)(c)}
    if mode not in kinds:
        raise ValueError(f"unknown mode {mode}")
    return by_library(index, library, app_only, lib_only).where(kinds[mode](F.col("name")).isNotNull())


def prefiltered(texts: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose JSON text can hold the query: a cheap test before the exact one on parsed values, and never stricter.

    A text in which a character may be escaped (any backslash) always passes.
    """
    c = F.col(column)
    return texts.where(F.contains(F.lower(c), F.lit(query.lower())) | F.contains(c, F.lit("\\")))


def name_or_signature(functions: DataFrame, text: str) -> DataFrame:
    """(module, function_id, how): functions whose name holds the text, else whose signature does; each once, by name first."""
    has = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    how = F.when(has("function_name"), "name").when(has("function_signature"), "signature")
    return functions.select("module", "function_id", how.alias("how")).where("how IS NOT NULL").distinct()


def normal_module(c: Column) -> Column:
    """A module's name without directory, case, an index's suffix (_dll_0123abcd.db) or an extension."""
    k = F.regexp_replace(module_key(c), r"_[0-9a-f]{6,}\.db$", "")
    return F.regexp_replace(F.regexp_replace(k, r"_(dll|exe|sys|ocx|drv)$", ".$1"), r"\.(dll|exe|sys|ocx|drv|db)$", "")


def resolve_modules(wanted: DataFrame, registry: DataFrame, complete: str = "COMPLETE") -> DataFrame:
    """(wanted, module, how) of each wanted name or path: exact by file name, else by name without extension if one module only has it.

    registry: (file_name, status).  how: exact, normal, incomplete (found, but its status isn't the complete one), ambiguous or missing.
    """
    r = registry.select(F.lower("file_name").alias("__e"), normal_module(F.col("file_name")).alias("__k"), "file_name", "status")
    w = wanted.select("wanted", module_key(F.col("wanted")).alias("__w"), normal_module(F.col("wanted")).alias("__n")).distinct()
    exact = w.join(r.select("__e", F.col("file_name").alias("__x"), F.col("status").alias("__xs")), F.col("__w") == F.col("__e"), "left")
    n = r.groupBy("__k").agg(F.count(F.lit(1)).alias("__c"), F.min("file_name").alias("__y"), F.min("status").alias("__ys"))
    j = exact.join(n, F.col("__n") == F.col("__k"), "left")
    found, status = F.coalesce("__x", F.when(F.col("__c") == 1, F.col("__y"))), F.coalesce("__xs", F.when(F.col("__c") == 1, F.col("__ys")))
    how = F.when(F.col("__x").isNull() & (F.col("__c") > 1), "ambiguous").when(found.isNull(), "missing").when(F.coalesce(status != complete, F.lit(True)), "incomplete").when(F.col("__x").isNotNull(), "exact").otherwise("normal")
    first = F.row_number().over(W.partitionBy("wanted").orderBy("__x", "__y"))
    return j.select("wanted", found.alias("module"), how.alias("how"), first.alias("__r")).where("__r = 1").drop("__r")
