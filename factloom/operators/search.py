"""Ranked search over several dimensions of facts: one table of candidates, matched and scored once."""

from __future__ import annotations

import difflib
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import cut

# Qualities of a match and weights of a score.
EXACT, PREFIX, BOUNDARY, INSIDE = 1.0, 0.85, 0.75, 0.6
WEIGHT, APP, CODE, EXPORT, DANGER = 0.5, 0.15, 0.10, 0.10, 0.05
BONUS, MOST_BONUS = 0.05, 0.15
#: Up to so many texts resolve() tries each on every name; more are joined by what they begin with (held()).
MOST_WANTED = 1_000
#: Characters that held() joins on.
GRAM = 3


def substring_quality(text: Column, query: str) -> Column:
    """1 equal, .85 prefix, .75 after '_' or between lower and upper case, .6 elsewhere; null without a match.

    Only the first occurrence is looked at.
    """
    if not query:
        return F.lit(None).cast("double")
    q = query.lower()
    low = F.lower(text)
    at = F.locate(q, low)
    before, first = F.substring(text, at - 1, F.lit(1)), F.substring(text, at, F.lit(1))
    edge = (before == "_") | (before.rlike("^[a-z]$") & first.rlike("^[A-Z]$"))
    return F.when(low == q, EXACT).when(at == 1, PREFIX).when((at > 1) & edge, BOUNDARY).when(at > 1, INSIDE)


def regex_quality(text: Column, pattern: str) -> Column:
    """1 for the whole text, else .6 + .4 * matched share, at most .99; a bad pattern matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(None).cast("double")
    found = F.regexp_substr(text, F.lit(f"(?i){pattern}"))
    share = F.length(found) / F.length(text)
    return F.when(F.length(found) == F.length(text), EXACT).when(found.isNotNull(), F.least(F.lit(0.99), F.lit(0.6) + F.lit(0.4) * share))


def literal_of(pattern: str) -> str | None:
    """The longest literal of at least three letters that every match of a simple pattern holds, for prefiltering."""
    if re.search(r"[|()\[\]{}?*+.]", re.sub(r"\\.", "", pattern)):
        parts = re.split(r"\\.|[|()\[\]{}^$]|.[?*]|[.+]", pattern) if "|" not in pattern and "(" not in pattern and "[" not in pattern else []
    else:
        parts = [re.sub(r"\\(\W)", r"\1", pattern.strip("^$"))] if not re.search(r"\\\w", pattern) else re.split(r"\\\w", pattern)
    best = max((p for p in parts if len(p) >= 3), key=len, default=None)
    return best


def fuzzy_quality(query: str, threshold: float = 0.6):
    """A pandas UDF: 1 equal, .85 prefix, .6 contained, else .3 + .25 * similarity from the threshold on."""
    q = query.lower()

    @F.pandas_udf(T.DoubleType())
    def quality(texts: pd.Series) -> pd.Series:
        match = difflib.SequenceMatcher(autojunk=False)
        match.set_seq2(q)
        known: dict[str, float | None] = {}

        def one(t: str | None) -> float | None:
            if not t or not q:
                return None
            t = t.lower()
            if t == q:
                return EXACT
            if t.startswith(q):
                return PREFIX
            if q in t:
                return INSIDE
            if t not in known:
                match.set_seq1(t)
                r = match.ratio() if match.real_quick_ratio() >= threshold and match.quick_ratio() >= threshold else 0
                known[t] = 0.3 + 0.25 * r if r >= threshold else None
            return known[t]

        return texts.map(one, na_action="ignore")

    return quality


def relevance(quality: Column, app: Column, code: Column, export: Column, danger: Column) -> Column:
    one = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(quality * WEIGHT + one(app, APP) + one(code, CODE) + one(export, EXPORT) + one(danger, DANGER), 4))


def candidates(functions: DataFrame) -> DataFrame:
    """(module, id, name, dim, pos, text, has_code, has_danger): the texts of parsed functions under each dimension."""
    f = functions.withColumn("has_code", F.coalesce("decompiled_code", F.lit("")) != "").withColumn("has_danger", F.size("dangerous") > 0)
    base = ["module", F.col("function_id").alias("id"), F.col("function_name").alias("name"), "has_code", "has_danger"]
    texts = {
        "name": F.array("function_name"),
        "signature": F.array("function_signature"),
        "string": F.col("strings"),
        "api": F.transform("outbound", lambda x: F.coalesce(x["function_name"], x["name"])),
        "dangerous": F.col("dangerous"),
        "class": F.flatten(F.transform("vtables", lambda v: F.coalesce(v["reconstructed_classes"], F.array(v["class_name"])))),
    }
    dims = F.array(*[F.struct(F.lit(n).alias("dim"), F.lit(i).alias("pos"), t.alias("texts")) for i, (n, t) in enumerate(texts.items())])
    d = f.select(*base, F.explode(dims).alias("d"))
    return d.select("module", "id", "name", "has_code", "has_danger", "d.dim", "d.pos", F.explode("d.texts").alias("text")).where("text IS NOT NULL AND text <> ''")


#: What a match among imports counts of one elsewhere, and the id of texts that belong to no function.
IMPORT_FACTOR, NO_ID = 0.9, -1


def with_module_texts(candidates_: DataFrame, exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Candidates and the texts of modules: exports (module, name, function_id) and imports (module, name), with flags `app`, `exported` and a `factor`.

    Exports count under their function, if it is known; imports under their name.  Functions that are exported have the flag in all dimensions.
    """
    e = exports.select("module", "name", F.coalesce("function_id", F.lit(NO_ID)).alias("id")).where("name IS NOT NULL").distinct()
    known = e.where(F.col("id") != NO_ID).select("module", "id").distinct().withColumn("exported", F.lit(True))
    base = candidates_.join(known, ["module", "id"], "left").withColumn("exported", F.coalesce("exported", F.lit(False)))
    flags = candidates_.groupBy("module", "id").agg(F.bool_or("has_code").alias("has_code"), F.bool_or("has_danger").alias("has_danger"))
    no = F.lit(False)
    e = e.join(flags, ["module", "id"], "left").select("module", "id", "name", F.coalesce("has_code", no).alias("has_code"), F.coalesce("has_danger", no).alias("has_danger"), F.lit("export").alias("dim"), F.lit(6).alias("pos"), F.col("name").alias("text"), F.lit(True).alias("exported"))
    i = imports.select("module", F.lit(NO_ID).cast("bigint").alias("id"), "name", no.alias("has_code"), no.alias("has_danger"), F.lit("import").alias("dim"), F.lit(7).alias("pos"), F.col("name").alias("text"), no.alias("exported")).where("name IS NOT NULL").distinct()
    out = base.unionByName(e).unionByName(i)
    return out.withColumn("app", F.col("dim") != "import").withColumn("factor", F.when(F.col("dim") == "import", IMPORT_FACTOR).otherwise(1.0))


def search(table: DataFrame, quality: Column, dims: Sequence[str] | None = None, per_dim: int | None = None) -> DataFrame:
    """(module, id, name, score, dim, dims): each function once, best dimension first, with a bonus for further ones.

    The best text of each dimension counts; ties go to the earlier dimension.  per_dim keeps the best
    rows of each dimension, after scoring.  Columns app, exported and factor (of with_module_texts) count where the
    table has them; texts of no function come together by name in any case.
    """
    t = table if dims is None else table.where(F.col("dim").isin(list(dims)))
    hit = t.withColumn("quality", quality).where("quality IS NOT NULL")
    has = lambda c, v: F.col(c) if c in table.columns else F.lit(v)
    score = relevance(F.col("quality"), has("app", True), F.col("has_code"), has("exported", False), F.col("has_danger"))
    hit = hit.withColumn("score", F.round(score * has("factor", 1.0), 4)).withColumn("__key", F.when(F.col("id") == NO_ID, F.lower("name")))
    best = hit.groupBy("module", "id", "__key", "dim", "pos").agg(F.min("name").alias("name"), F.max("score").alias("score"))
    if per_dim is not None:
        r = F.row_number().over(W.partitionBy("dim").orderBy(F.desc("score"), "module", "id", "__key"))
        best = best.withColumn("__r", r).where(F.col("__r") <= per_dim).drop("__r")
    flat = best.groupBy("module", "id", "__key").agg(F.min("name").alias("name"), F.max(F.struct("score", -F.col("pos"), "dim")).alias("b"), F.count(F.lit(1)).alias("dims"))
    bonus = F.when(F.col("dims") > 1, F.least(F.lit(MOST_BONUS), BONUS * F.col("dims"))).otherwise(0.0)
    return flat.select("module", "id", "name", F.least(F.lit(1.0), F.round(F.col("b.score") + bonus, 4)).alias("score"), F.col("b.dim").alias("dim"), "dims")


def snippet(text: Column, query: str, before: int = 20, after: int = 40) -> Column:
    """The text around the first match, with an ellipsis where it is cut."""
    at = F.locate(query.lower(), F.lower(text))
    a = F.greatest(F.lit(1), at - before)
    n = F.lit(before + after + len(query))
    cutoff = F.when(a + n - 1 < F.length(text), "...").otherwise("")
    return F.when(at > 0, F.concat(F.when(a > 1, "...").otherwise(""), F.substring(text, a, n), cutoff))


def held(names: DataFrame, name: str, wanted: DataFrame, text: str) -> DataFrame:
    """Pairs of a name and a wanted text that it holds, by an equality join on the text's first characters.

    Each name is listed under all its different pieces of up to GRAM characters, each text under its first one, so
    any number of texts can be looked for.  Null names hold nothing; a null or empty text is held by none.
    """
    at = F.sequence(F.lit(1), F.length(name))
    of = lambda k: F.transform(at, lambda i: F.substring(F.col(name), i, F.lit(k)))
    pieces = F.array_distinct(F.flatten(F.array(*map(of, range(1, GRAM + 1)))))
    n = names.where(F.length(name) > 0).withColumn("__gram", F.explode(pieces))
    w = wanted.where(F.length(text) > 0).withColumn("__gram", F.substring(text, 1, GRAM))
    return n.join(w, "__gram").where(F.contains(F.col(name), F.col(text))).drop("__gram")


def resolve(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, module, name, how): each wanted text as an id, an exact name, else a substring that only one name has; ambiguous ones say so.

    names: (module, id, name); wanted: (wanted).
    """
    n = names.select("module", "id", "name", F.lower("name").alias("__low"))
    w = wanted.select("wanted", F.lower("wanted").alias("__w"), F.col("wanted").try_cast("bigint").alias("__id")).distinct()
    by_id = w.join(n, F.col("__id") == F.col("id")).select("wanted", "module", "name", F.lit("id").alias("how"), F.lit(0).alias("p"))
    exact = w.join(n, F.col("__w") == F.col("__low")).select("wanted", "module", "name", F.lit("exact"), F.lit(1))
    rest = w.join(by_id.select("wanted").union(exact.select("wanted")).distinct(), "wanted", "left_anti")
    rest = cut(rest)
    part = n.join(F.broadcast(rest), F.contains(F.col("__low"), F.col("__w"))) if rest.limit(MOST_WANTED + 1).count() <= MOST_WANTED else held(n, "__low", rest, "__w")
    one = part.groupBy("wanted").agg(F.count(F.lit(1)).alias("c"), F.min("module").alias("module"), F.min("name").alias("name"))
    partial = one.select("wanted", F.when(F.col("c") == 1, F.col("module")).alias("module"), F.when(F.col("c") == 1, F.col("name")).alias("name"), F.when(F.col("c") == 1, "partial").otherwise("ambiguous"), F.lit(2))
    every = by_id.union(exact).union(partial)
    first = every.groupBy("wanted").agg(F.min("p").alias("__least"))
    return every.join(first, "wanted").where("p = __least").drop("p", "__least")
