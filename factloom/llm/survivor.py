"""One surviving record per group of duplicates, chosen field by field.

Currency reasoning: from rows that carry a time, learn which value tends to follow which; where
times are missing, a group's values are ordered by what was learned, and the topologically latest wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.columns import fresh

#: Values whose order can be learned; the learned table has at most the square of it.
MAX_VALUES = 64

_EARLIEST = -(2**63)


def whole_json(c: Column) -> Column:
    """A text as a variant if it is one whole JSON value, else null.

    The parser stops after a first whole value; what follows it can be valid inside an array or inside an
    object, but not inside both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    inside = F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit("}")))
    return F.when(inside.isNotNull(), F.try_variant_get(listed, F.lit("$[0]"), "variant"))


def with_evidence_lines(df: DataFrame, column: str, name: str) -> DataFrame:
    """The table with a count of the non-blank strings that a JSON text lists, in place of that text.

    0 for null, blank and broken texts.  JSON in a JSON string is read as JSON; a lone string is one line.
    Each step is a column of its own, so that every text is parsed once.
    """
    v, t, w = fresh("__v", df), fresh("__t", df), fresh("__w", df)
    is_text = F.schema_of_variant(F.col(v)) == "STRING"
    df = df.withColumn(v, whole_json(F.col(column))).withColumn(t, F.when(is_text, F.try_variant_get(v, F.lit("$"), "string")))
    df = df.withColumn(w, F.when(F.col(t).isNull(), F.col(v)).otherwise(whole_json(F.col(t))))
    lines = F.try_variant_get(w, F.lit("$"), "array<variant>")
    held = F.filter(lines, lambda x: F.coalesce(F.try_variant_get(x, F.lit("$"), "string").rlike(r"\S") & (F.schema_of_variant(x) == "STRING"), F.lit(False)))
    lone = F.when(F.col(t).rlike(r"\S") & ~F.col(t).rlike(r"^\s*[\[{]") & (F.col(w).isNull() | (F.schema_of_variant(F.col(w)) == "STRING")), 1)
    count = F.size(held)  # -1 where there is no array
    return df.withColumn(name, F.greatest(F.when(count >= 0, count).otherwise(F.coalesce(lone, F.lit(0))), F.lit(0)).cast("int")).drop(v, t, w, column)


def best(rank: Column | None, when: Column, ident: Column, *carry: Column) -> Column:
    """An aggregate: the row of highest rank (null lowest), then latest time (null earliest), then smallest id."""
    head = [rank.alias("rank")] if rank is not None else []
    return F.max(F.struct(*head, F.coalesce(when, F.lit(_EARLIEST)).alias("when"), (-ident).alias("minus_id"), *carry))


def survivor_ids(rows: DataFrame, keys: Sequence[str], ident: str, when: str, ranks: dict[str, str], least: int = 2) -> DataFrame:
    """Per group of at least `least` rows: keys, n, first_id, recent_id, and <field>_id for each ranked field.

    ranks: field -> column of its rank (null or 0: the row has no such value; the id is 0 if no row has one).
    All choices are made in one aggregation that combines before the shuffle, so a group of any size
    is never gathered.  Rows with a null key form no group; repeated rows count each.
    """
    i, t = F.col(ident), F.col(when)
    aggs = [F.count(F.lit(1)).alias("n"), F.min(i).alias("first_id"), best(None, t, i).alias("__recent")]
    aggs += [best(F.when(F.col(c) > 0, F.col(c)), t, i).alias(f"__{name}") for name, c in ranks.items()]
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    out = rows.where(cond).groupBy(*keys).agg(*aggs).where(F.col("n") >= least)
    ids = [F.when(F.col(f"__{name}.rank").isNotNull(), -F.col(f"__{name}.minus_id")).otherwise(0).alias(f"{name}_id") for name in ranks]
    return out.select(*keys, "n", "first_id", (-F.col("__recent.minus_id")).alias("recent_id"), *ids)


def learn_precedence(rows: DataFrame, keys: Sequence[str], value: str, when: str, values: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs (earlier, later) of values, closed under transitivity and without cycles.

    In each group the known values are put in order of their latest time; each step from one to
    the next is a transition.  Transitions with the clearest majority are taken first, unless
    they would close a cycle.  Only a table of at most MAX_VALUES squared counts reaches the driver.
    """
    if len(values) > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} values")
    seen = rows.where(F.col(when).isNotNull() & F.col(value).isin(list(values))).groupBy(*keys, value).agg(F.max(when).alias("__t"))
    chains = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__t").alias("t"), F.col(value).alias("v")))).alias("__c")).where(F.size("__c") > 1)
    n = F.size("__c")
    steps = F.arrays_zip(F.slice("__c", 1, n - 1).alias("a"), F.slice("__c", 2, n - 1).alias("b"))
    counts = {
        (r["a"], r["b"]): r["n"]
        for r in chains.select(F.explode(steps).alias("s")).where("s.a.t < s.b.t").groupBy(F.col("s.a.v").alias("a"), F.col("s.b.v").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    margin = sorted(((n - counts.get((b, a), 0), a, b) for (a, b), n in counts.items() if n > counts.get((b, a), 0)), key=lambda x: (-x[0], x[1], x[2]))
    after: dict[str, set[str]] = {v: set() for v in values}
    for _, a, b in margin:
        if a not in after[b]:
            for x in values:
                if x == a or a in after[x]:
                    after[x] |= {b} | after[b]
    return sorted((a, b) for a in values for b in after[a])


def declared_precedence(rank: dict[str, float]) -> list[tuple[str, str]]:
    """Pairs (earlier, later) of values whose order is given by a number; equal ones stay incomparable."""
    if len(rank) > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} values")
    return sorted((a, b) for a in rank for b in rank if rank[a] < rank[b])


def topological_rank(value: Column, values: Sequence[str], precedence: Sequence[tuple[str, str]]) -> Column:
    """1 + how many values come before this one in a closed order; null for other values.

    A value that follows another one has the higher rank, so the highest rank is a topologically latest value.
    """
    if not values:
        return F.lit(None).cast("int")
    before = {v: 1 + sum(b == v for _, b in precedence) for v in values}
    return F.try_element_at(F.create_map(*[x for v, n in before.items() for x in (F.lit(v), F.lit(n))]), value)


def current_value(rows: DataFrame, keys: Sequence[str], value: str, when: str, values: Sequence[str], precedence: Sequence[tuple[str, str]]) -> DataFrame:
    """(keys, current): the topologically latest known value of each group; null if it has none.

    Values with a time are ordered by it.  A value of a row without a time comes after the latest
    timed one only if the learned order says so; among several, one that no other follows is
    taken, the first by name.  The group's work is on its distinct known values only.
    """
    known = rows.where(F.col(value).isin(list(values))).groupBy(*keys, value).agg(F.max(when).alias("__t"))
    groups = known.groupBy(*keys).agg(
        F.max_by(value, F.struct("__t", value)).alias("__last"), F.max("__t").alias("__lt"), F.array_sort(F.collect_set(F.when(F.col("__t").isNull(), F.col(value)))).alias("__open")
    )
    pairs = F.array(*[F.lit(f"{a}\x00{b}") for a, b in precedence]) if precedence else F.array().cast("array<string>")
    follows = lambda a, b: F.array_contains(pairs, F.concat(a, F.lit("\x00"), b))
    timed = F.when(F.col("__lt").isNotNull(), F.col("__last"))
    later = F.filter("__open", lambda u: timed.isNull() | F.coalesce(follows(timed, u), F.lit(False)))
    top = F.filter(later, lambda u: ~F.exists(later, lambda w: follows(u, w)))
    return groups.select(*keys, F.coalesce(F.get(top, F.lit(0)), timed).alias("current"))
