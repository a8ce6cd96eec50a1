"""Reading one thing out of its many spellings: modules, names, terms, instants, keys.

All functions give Columns, so cleaning stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks that an importing stub puts before a name.
IMPORT_PREFIXES = ("__imp_", "_imp_", "j_", "cs:")

_PREFIX_PATTERN = "^(" + "|".join(IMPORT_PREFIXES) + ")"

#: A vocabulary is compared term by term with each misspelling, so it has to be small.
MAX_VOCABULARY = 10_000


#: Blanks that are taken off both ends of a text.
BLANKS = " \t\n\r\f\v\u00a0\u2007\u202f\u3000\ufeff"


def strip_blank(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def module_key(c: Column) -> Column:
    """File name in lower case without its directory; null if nothing is left."""
    name = F.lower(F.regexp_extract(strip_blank(c), r"([^/\\]*)$", 1))
    return F.when(name != "", name)


def name_key(c: Column) -> Column:
    """A function name for comparison: trimmed, one import mark removed, lower case."""
    name = F.lower(F.regexp_replace(strip_blank(c), _PREFIX_PATTERN, ""))
    return F.when(name != "", name)


def slug(c: Column) -> Column:
    """Letters and digits only, in lower case: equal for spellings that differ in case, blanks or hyphens."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def term_slug(c: Column) -> Column:
    return slug(F.regexp_replace(strip_blank(F.lower(c)), _PREFIX_PATTERN, ""))


def vocabulary(df: DataFrame, column: str) -> list[str]:
    """The distinct terms of a small fixed table; refuses a table that isn't small."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"{column}: more than {MAX_VOCABULARY} terms; a vocabulary has to be small")
    return sorted(r[0] for r in rows)


def _slug(term: str) -> str:
    return "".join(ch for ch in term.lower() if ch.isalnum())


def nearest_term(s: Column, terms: list[str]) -> Column:
    """The term that a slug (of term_slug) means: the one with the same slug, else the nearest one.

    Distance is the edit distance on slugs, where a swap of two letters counts once.
    It has to be under half the slug's length.  Ties go to the first term in order.
    Null and empty slugs and far-off ones give null.  Give the slug as a column of its own: it is used
    once per term where no term is equal.
    """
    if not terms:
        return F.lit(None).cast("string")
    exact = F.create_map(*[x for t in {_slug(t): t for t in reversed(terms)}.items() for x in map(F.lit, t)])
    letters = lambda x: F.array_join(F.array_sort(F.split(x, "")), "")
    listed = F.array(*[F.struct(F.lit(_slug(t)).alias("s"), F.lit("".join(sorted(_slug(t)))).alias("l"), F.lit(t).alias("t")) for t in terms])

    def scored(t: Column) -> Column:
        d = F.levenshtein(s, t["s"])
        swapped = (d == 2) & (F.length(s) == F.length(t["s"])) & (letters(s) == t["l"])
        return F.struct(F.when(swapped, 1).otherwise(d).alias("d"), t["t"].alias("t"))

    near = F.filter(F.array(F.array_min(F.transform(listed, scored))), lambda x: x["d"] * 2 < F.length(s))
    return F.when(s != "", F.coalesce(F.try_element_at(exact, s), F.get(near, F.lit(0))["t"]))


def micros(c: Column) -> Column:
    """An instant written as text, as microseconds since 1970 (bigint).

    Takes ISO forms with a zone, ISO forms without one (UTC) and epoch seconds; anything else is null.
    Doesn't depend on the session's time zone.
    """
    t = strip_blank(c)
    epoch = t.rlike(r"^-?\d+(\.\d+)?$")
    dated = t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ]|$)")  # a time of day alone would be taken as today's
    clock = t.rlike(r"\d:\d")
    zoned = clock & t.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$")
    seconds = F.when(epoch, t).try_cast("decimal(20,6)")
    iso = F.when(dated & zoned, t).when(dated & clock, F.concat(t, F.lit("Z"))).when(dated, F.concat(t, F.lit("T00:00:00Z")))
    return F.coalesce((seconds * 1_000_000).try_cast("bigint"), F.unix_micros(iso.try_cast("timestamp")))


def function_number(c: Column) -> Column:
    """A function id written in decimal or as 0x...; null for anything else."""
    t = F.lower(strip_blank(c))
    hexed = t.rlike("^0x[0-9a-f]{1,15}$")
    return F.when(hexed, F.conv(F.substring(t, 3, 15), 16, 10).try_cast("bigint")).when(t.rlike(r"^\d{1,18}$"), t.try_cast("bigint"))
