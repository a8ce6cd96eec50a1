"""Classes and interfaces seen in code: roles of functions, skeletons, tables of methods, and templates of runtime classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unique id as written in code and texts.
GUID = r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"


def guids(text: Column) -> Column:
    """All unique ids in a text, in order, repeated ones each."""
    return F.regexp_extract_all(text, F.lit(f"({GUID})"), F.lit(1))


def implementations(functions: DataFrame) -> DataFrame:
    """(module, class, role, n) of functions (module, function_name) by the class that their names say; class '' for none."""
    name = F.col("function_name")
    role = F.when(F.contains(name, F.lit("::~")) | name.startswith("~"), "destructor").when(F.contains(name, F.lit("::")), "method").otherwise("function")
    f = functions.where(name.isNotNull()).select("module", F.when(role == "function", "").otherwise(F.regexp_extract(name, "^(.*)::[^:]+$", 1)).alias("class"), role.alias("role"))
    return f.groupBy("module", "class", "role").agg(F.count(F.lit(1)).alias("n"))


def first_skeletons(skeletons: DataFrame) -> DataFrame:
    """(module, skeleton, function_id, copies): each text once per module, under its first function.  Null and empty texts are none."""
    return skeletons.where("skeleton <> ''").groupBy("module", "skeleton").agg(F.min("function_id").alias("function_id"), F.count(F.lit(1)).alias("copies"))


def table_grade(methods: Column, class_name: Column) -> Column:
    """A struct (grade, base, first_own) of a table of methods: array of names by slot.

    high: the three methods of the basic interface are at slots 0 to 2 (those of the inspectable one at 3 to 5 make it the
    base); medium: some of them anywhere; low: only the class's name hints at an interface; none else.  Nulls are no methods.
    """
    ms = F.coalesce(methods, F.array().cast("array<string>"))
    at = lambda i, x: F.coalesce(F.contains(F.get(ms, F.lit(i)), F.lit(x)), F.lit(False))
    has = lambda x: F.exists(ms, lambda m: F.coalesce(F.contains(m, F.lit(x)), F.lit(False)))
    basic = at(0, "QueryInterface") & at(1, "AddRef") & at(2, "Release")
    inspectable = basic & at(3, "GetIids") & at(4, "GetRuntimeClassName") & at(5, "GetTrustLevel")
    some = has("QueryInterface") | has("AddRef") & has("Release")
    c = F.coalesce(class_name, F.lit(""))
    named = (F.size(ms) > 0) & (F.contains(c, F.lit("Microsoft::WRL")) | F.contains(c, F.lit("RuntimeClassImpl")) | F.contains(c, F.lit("FtmBase")) | c.rlike("^I[A-Z]"))
    grade = F.when(basic, "high").when(some, "medium").when(named, "low").otherwise("none")
    base = F.when(inspectable, "IInspectable").when(grade != "none", "IUnknown")
    return F.struct(grade.alias("grade"), base.alias("base"), F.when(inspectable, 6).when(basic, 3).otherwise(0).alias("first_own"))


def _top_level(text: Column) -> Column:
    """A comma list split where no angle bracket is open."""
    parts = F.split(text, ",")
    opened = lambda s: F.length(F.regexp_replace(s, "[^<]", "")) - F.length(F.regexp_replace(s, "[^>]", ""))

    def step(acc: Column, part: Column) -> Column:
        inside = acc["depth"] > 0
        grown = F.when(inside, F.concat(acc["open"], F.lit(","), part)).otherwise(part)
        depth = F.greatest(F.lit(0), acc["depth"] + opened(part))
        closed = depth == 0
        return F.struct(F.when(closed, F.concat(acc["done"], F.array(F.trim(grown)))).otherwise(acc["done"]).alias("done"), F.when(closed, F.lit("")).otherwise(grown).alias("open"), depth.alias("depth"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("depth"))
    return F.aggregate(parts, start, step, lambda a: F.filter(F.when(a["open"] != "", F.concat(a["done"], F.array(F.trim(a["open"])))).otherwise(a["done"]), lambda x: x != ""))


def template(name: Column) -> Column:
    """A struct (flags, weak, inspectable, interfaces, free_threaded) of a runtime-class template in a name; null for other names.

    flags is the digit of its class flags; interfaces are the listed ones at the outermost level, without the free-threaded base.
    """
    # the arguments after the flags: up to three digits of the full form, then the interfaces up to the template's end
    inside = F.regexp_extract(name, r"RuntimeClass(?:Impl)?<[^>]*RuntimeClassFlags<\d>([^~]*)>(?:::|$)", 1)
    flags = F.regexp_extract(name, r"RuntimeClass(?:Impl)?<[^>]*RuntimeClassFlags<(\d)>", 1)
    digits = F.regexp_extract(inside, r"^,\s*(\d),\s*(\d),\s*(\d),", 0) != ""
    digit = lambda i: F.when(digits, F.regexp_extract(inside, r"^,\s*(\d),\s*(\d),\s*(\d),", i) == "1").otherwise(False)
    listed = _top_level(F.regexp_replace(inside, r"^,\s*(?:\d,\s*){3}|^,\s*", ""))
    own = F.filter(listed, lambda x: ~F.contains(x, F.lit("FtmBase")) & ~x.rlike("^Microsoft::WRL::.*Implements"))
    out = F.struct(flags.try_cast("int").alias("flags"), digit(1).alias("weak"), digit(2).alias("inspectable"), own.alias("interfaces"), F.exists(listed, lambda x: F.contains(x, F.lit("FtmBase"))).alias("free_threaded"))
    return F.when(flags != "", out)


def class_interfaces(functions: DataFrame, name: str) -> DataFrame:
    """(class, interfaces): the interfaces that templates in names list for each class (the name before the last ::)."""
    t = functions.select(F.regexp_extract(name, r"^(.*)::[^:>]*$", 1).alias("class"), template(F.col(name)).alias("t")).where("t IS NOT NULL")
    return t.groupBy("class").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("t.interfaces")))).alias("interfaces"))
