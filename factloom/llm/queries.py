"""Queries p1, p3, p4 and p6 to p9 over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.columns import computed, table, unit_number
from factloom.functions.cleaning import function_number, micros, module_key, name_key, slug, strip_blank
from factloom.llm.cutoff import cutoffs, valid_interest
from factloom.llm.oracles import ORACLES
from factloom.llm.segments import END, near_repeats, repeats
from factloom.llm.survivor import MAX_VALUES, current_value, declared_precedence, learn_precedence, survivor_ids, topological_rank, with_evidence_lines
from factloom.llm.topn import bucket, ranked, survivors
from factloom.operators.skew import lookup_join
from factloom.plans.identity import IDENTITY, function_names, identified, key_array, key_parts
from factloom.session import cut

__all__ = ["QUERIES", "ORACLES"]


def latest_classification(records: DataFrame) -> DataFrame:
    """(module, function_id, category, interest) of each function's latest record; a null time is earliest."""
    rows = records.select(module_key(F.col("module")).alias("module"), "function_id", "classified_at", "interest_score", "primary_category").where("module IS NOT NULL AND function_id IS NOT NULL")
    return rows.groupBy("module", "function_id").agg(F.max(F.struct("classified_at", "interest_score", "primary_category")).alias("r")).select(
        "module", "function_id", F.col("r.primary_category").alias("category"), valid_interest(F.col("r.interest_score")).alias("interest")
    )


def _cutoffs(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "keep_targets").withColumn("key", slug(F.col("primary_category"))).where("key <> ''")
    latest = latest_classification(table(spark, d, "classification_results")).withColumn("key", slug(F.col("category")))
    out = cutoffs(latest.where("key <> ''"), "key", "interest", targets, "key", "keep_fraction")
    names = targets.groupBy("key").agg(F.min("primary_category").alias("primary_category"))
    return lookup_join(out, names, ["key"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _cutoffs(spark, d).select("primary_category", F.col("cutoff").cast("int").alias("cutoff"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Cutoffs with the sizes that they keep."""
    return _cutoffs(spark, d).select("primary_category", F.col("cutoff").cast("int").alias("cutoff"), "kept", "scored", F.col("fraction").alias("keep_fraction"))


def _stated(spark: SparkSession, d: str, *carry: str) -> DataFrame:
    return identified(table(spark, d, "findings"), table(spark, d, "module_functions"), table(spark, d, "taxonomy"), *carry)


def _statuses(spark: SparkSession, d: str) -> tuple[dict[str, str], dict[str, int]]:
    """Known statuses by slug, and their trust; of several spellings the most trusted counts."""
    rows = table(spark, d, "status_trust").where("status IS NOT NULL AND trust IS NOT NULL").limit(MAX_VALUES + 1).collect()
    if len(rows) > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} statuses")
    best: dict[str, tuple[int, str]] = {}
    for r in rows:
        k = "".join(ch for ch in r["status"].lower() if ch.isalnum())
        best[k] = max(best.get(k, (r["trust"], r["status"])), (r["trust"], r["status"]))
    return {k: s for k, (_, s) in best.items()}, {s: t for t, s in best.values()}


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, int]]:
    """Stated findings with their known status, its rank in the order of trust, their time and lines of evidence."""
    names, trust = _statuses(spark, d)
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.lit(None).cast("map<string,string>")
    plain = table(spark, d, "findings").select("id", "module", "dedup_key", "function_id", "sink", "source_category", "verification_status", "updated_at", "evidence_lines_json")
    plain = with_evidence_lines(plain, "evidence_lines_json", "lines")
    plain = computed(plain, ["id", "module", "dedup_key", "function_id", "sink", "source_category", "lines"], status=F.try_element_at(known, slug(F.col("verification_status"))), when=micros(F.col("updated_at")))
    rows = identified(plain, table(spark, d, "module_functions"), table(spark, d, "taxonomy"), "status", "when", "lines")
    return rows.withColumn("rank", topological_rank(F.col("status"), sorted(trust), declared_precedence(trust))), trust


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _ranked(spark, d)
    out = survivor_ids(rows, IDENTITY, "id", "when", {"status": "rank", "evidence": "lines"})
    return out.select("first_id", "status_id", "recent_id", "evidence_id")


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Each group's size, chosen rows and current status, the last by currency reasoning on status and time."""
    rows, trust = _ranked(spark, d)
    rows = cut(rows)
    values = sorted(trust)
    order = learn_precedence(rows, IDENTITY, "status", "when", values)
    now = current_value(rows, IDENTITY, "status", "when", values, order)
    out = survivor_ids(rows, IDENTITY, "id", "when", {"status": "rank", "evidence": "lines"})
    return out.join(now, list(IDENTITY), "left").select(*IDENTITY, "n", "first_id", "status_id", "recent_id", "evidence_id", F.col("current").alias("current_status"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    f = computed(table(spark, d, "findings"), ["id", "function_id", "score", "module", "function_name"], a=key_array(F.col("dedup_key")))
    f = computed(f, ["id"], module=module_key(F.col("module")), name_key=name_key(F.col("function_name")), score=unit_number(F.col("score")), function_id=F.coalesce("function_id", function_number(key_parts(F.col("a"))["function"])))
    rows = cut(f.where("module IS NOT NULL AND name_key IS NOT NULL AND score IS NOT NULL").withColumn("bucket", bucket(F.col("score"))))
    names = function_names(table(spark, d, "module_functions")).select("module", "name_key", "only_id")
    best = survivors(rows, ["module", "name_key"], "bucket", 3, names, ["id"])
    best = best.withColumn("function_id", F.coalesce("function_id", "only_id")).select("id", "module", "name_key", "score", "function_id")
    interest = latest_classification(table(spark, d, "classification_results")).where("interest IS NOT NULL").select("module", "function_id", "interest")
    tied = lookup_join(best, interest, ["module", "function_id"], "left", spread_by=["id"])
    return ranked(tied, ["module", "name_key"], [F.col("score").desc(), F.col("interest").desc_nulls_last(), F.col("id")], 3).select("id", "place")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    run = lambda c: F.lower(strip_blank(F.col(c)))
    runs = table(spark, d, "scan_runs").select(run("run_id").alias("run"), F.unix_micros("started_at").alias("started")).where("run IS NOT NULL AND run <> ''").groupBy("run").agg(F.min("started").alias("started"))
    rows = _stated(spark, d, "run_id", "created_at").withColumn("run", run("run_id"))
    text = F.concat_ws("\x01", *IDENTITY)
    rows = lookup_join(rows, runs, ["run"], spread_by=["id"]).select("id", F.translate(text, END, "").alias("stated"), F.col("started").alias("batch"), micros(F.col("created_at")).alias("created"))
    pairs = repeats(cut(rows), "stated", ["batch", "created"], "id")
    return pairs.select(F.least("first_id", "id").alias("id_a"), F.greatest("first_id", "id").alias("id_b"))


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """Findings whose summary is a near copy of one that an earlier run, or an earlier row of its run, stored: a row for each such summary, under the id of its first row, with the coverage and how many there are.  Copies count as near."""
    run = lambda c: F.lower(strip_blank(F.col(c)))
    runs = table(spark, d, "scan_runs").select(run("run_id").alias("run"), F.unix_micros("started_at").alias("started")).where("run IS NOT NULL AND run <> ''").groupBy("run").agg(F.min("started").alias("started"))
    rows = table(spark, d, "findings").select("id", "summary", run("run_id").alias("run"), micros(F.col("created_at")).alias("created"))
    rows = lookup_join(rows, runs, ["run"], spread_by=["id"])
    return near_repeats(rows, "summary", ["started", "created"], "id", each=True)


# Tokenizers and character properties are imported where they are used: the other queries don't need their libraries.


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    from factloom.llm.encode import encode

    return encode(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from factloom.llm.mix import packed

    return packed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1].where("NOT reachable").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that a mixture as large as its sources reaches."""
    from factloom.llm.mix import mix

    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    from factloom.llm.mix import mix

    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from factloom.llm.sentences import sentences

    return sentences(table(spark, d, "documents"), "doc_id", "text", "lang")


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p3_found": p3_found,
    "p3_survivors": p3_survivors,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p6_near": p6_near,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_mix": p8_mix,
    "p9_found": p9_found,
}
