"""Composite scores as column arithmetic: weights are parameters, normalisation is a window or one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalar import hop_decay

# Weights of an entry's score and of an assessment.
ENTRY_WEIGHTS = {"parameters": 0.25, "danger": 0.30, "depth": 0.15, "reach": 0.15, "kind": 0.15}
FINDING_WEIGHTS = {"impact": 0.35, "trigger": 0.25, "confidence": 0.20, "reach": 0.20}
ASSESSMENT_WEIGHTS = {"severity": 0.35, "primitive": 0.25, "bypass": 0.25, "reach": 0.15}
CONFIDENCE = {"LOW": 0.4, "MEDIUM": 0.65, "HIGH": 0.85}
INTEREST_MOST = 10


def decayed(weight: Column, hops: Column) -> Column:
    return weight * hop_decay(hops)


def trigger(guards: Column, hops: Column) -> Column:
    """How easily a path is triggered: 1 less .12 per guard, at least .1, by the decay of its hops."""
    return F.greatest(F.lit(0.1), 1 - 0.12 * guards) * hop_decay(hops)


def weighted(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """The weighted sum of the parts, missing and null parts as 0, at most 1."""
    total = F.lit(0.0)
    for name, w in weights.items():
        if name in parts:
            total = total + w * F.coalesce(parts[name].cast("double"), F.lit(0.0))
    return F.least(F.lit(1.0), total)


def entry_score(df: DataFrame, key: str, danger: str, depth: str, parameters: Column, reach: str | None = None, kind: Column | None = None) -> DataFrame:
    """df with a score of each entry: danger and reach are taken relative to their greatest value (0 counts as 1)."""
    names = [danger] + ([reach] if reach else [])
    tops = df.agg(*[F.max(c).alias(f"__max_{c}") for c in names], F.lit(1).alias("__one"))
    d = df.withColumn("__one", F.lit(1)).join(F.broadcast(tops), "__one")  # one row
    rel = lambda c: F.col(c) / F.when(F.col(f"__max_{c}") == 0, 1).otherwise(F.col(f"__max_{c}"))
    parts = {"parameters": parameters, "danger": rel(danger), "depth": 1 / (1 + F.col(depth))}
    if reach:
        parts["reach"] = rel(reach)
    if kind is not None:
        parts["kind"] = kind
    return d.withColumn("score", F.round(weighted(parts, ENTRY_WEIGHTS), 6)).select(*df.columns, "score")


def finding_score(impact: Column, guards: Column, hops: Column, confidence: Column, reach: Column) -> Column:
    return weighted({"impact": impact, "trigger": trigger(guards, hops), "confidence": confidence, "reach": reach}, FINDING_WEIGHTS)


def confidence_factor(confidence: Column) -> Column:
    """The factor of a confidence level; unknown levels count as LOW."""
    factor = F.lit(CONFIDENCE["LOW"])
    for k, v in CONFIDENCE.items():
        factor = F.when(F.upper(confidence) == k, v).otherwise(factor)
    return factor


def assessment(severity: Column, primitive: Column, bypass: Column, reach: Column, confidence: Column) -> Column:
    """To 3 decimals, scaled by the confidence level's factor."""
    return F.round(weighted({"severity": severity, "primitive": primitive, "bypass": bypass, "reach": reach}, ASSESSMENT_WEIGHTS) * confidence_factor(confidence), 3)


def interest(danger: Column, loops: Column, complexity: Column, strings: Column, has_code: Column, penalty: Column) -> Column:
    """0 to 10 from counts: up to 3 for dangerous calls, one each for loops, complexity, strings and code, less a penalty."""
    one = lambda c: F.when(c, 1).otherwise(0)
    s = F.least(danger, F.lit(3)) + one(loops >= 2) + one(complexity >= 5) + one(strings > 3) + one(has_code) - penalty
    return F.greatest(F.lit(0), F.least(F.lit(INTEREST_MOST), s)).cast("int")


def best_category(weights: DataFrame, key: Sequence[str], category: str, weight: str, order: str) -> DataFrame:
    """(key, category, total): the category of the greatest summed weight; ties go to the first by order."""
    s = weights.groupBy(*key, category).agg(F.sum(weight).alias("total"), F.min(order).alias("__o"))
    return s.groupBy(*key).agg(F.max_by(category, F.struct("total", -F.col("__o"))).alias(category), F.max("total").alias("total"))


def risk_tier(flags: Sequence[tuple[str, Column]], lowest: str = "low") -> Column:
    """The first tier whose condition holds."""
    out = None
    for name, c in flags:
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(lowest) if out is not None else F.lit(lowest)


def verified_score(score: Column, confidence: Column, feasible: Column) -> DataFrame:
    """Score times 1, .7, .3 or 0 by the verifier's confidence, to 3 decimals; an infeasible path gives 0."""
    f = F.when(~F.coalesce(feasible, F.lit(True)), 0.0).when(F.upper(confidence) == "CONFIRMED", 1.0).when(F.upper(confidence) == "LIKELY", 0.7).when(F.upper(confidence) == "UNCERTAIN", 0.3).otherwise(0.0)
    return F.round(score * f, 3)


def deepen(findings: DataFrame, severity: str, score: str) -> DataFrame:
    """One row: whether a second pass is due (two critical, five high, or a score of .75)."""
    up = F.upper(F.col(severity))
    return findings.agg((F.coalesce(F.count_if(up == "CRITICAL") >= 2, F.lit(False)) | (F.count_if(up == "HIGH") >= 5) | F.coalesce(F.max(score) >= 0.75, F.lit(False))).alias("deepen"))


def pick_callees(candidates: DataFrame, tier: str, apis: str, tie: str, most: int = 4) -> DataFrame:
    """The first callees by tier, then by most APIs, among those with code."""
    return candidates.where("has_code").orderBy(tier, F.desc(apis), tie).limit(most)
