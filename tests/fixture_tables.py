"""Small folders of the fact tables: hand-made rows, empty tables, and tables with extra columns."""

from __future__ import annotations

from pyspark.sql import functions as F

FINDINGS = (
    "id bigint, dedup_key string, function_name string, function_id bigint, module string, source_type string, source_category string, sink string, sink_category string, severity string, "
    "score double, exploitability_score double, exploitability_rating string, verification_status string, guards_json string, path_json string, evidence_lines_json string, extra_json string, "
    "summary string, run_id string, created_at string, updated_at string"
)
CLASSES = "module string, function_id bigint, function_name string, primary_category string, interest_score int, classified_at timestamp"
FUNCTIONS = "module_id string, function_id bigint, function_name string"
RUNS = "run_id string, module string, status string, started_at timestamp"
SCHEMAS = {
    "findings": FINDINGS,
    "classification_results": CLASSES,
    "module_functions": FUNCTIONS,
    "scan_runs": RUNS,
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, module string",
    "taxonomy": "term string, kind string, sink_category string",
    "status_trust": "status string, trust int",
    "keep_targets": "primary_category string, keep_fraction double",
    "mix_targets": "source string, target_share double, max_repeats int",
}

FUNCTION_ROWS = [("A.dll", 1, "Run"), ("a.dll", 2, "Run"), ("a.dll", 3, "Open"), ("B.exe", 1, "Open"), (None, 5, "x"), ("a.dll", 6, None)]
TERMS = [("VaultOpen", "sink", "p"), ("VaultOpenEx", "sink", "p"), ("type_mixup", "source_category", None), ("sign_flip", "source_category", None)]
TRUST = [("CONFIRMED", 50), ("FALSE_POSITIVE", 40), ("LIKELY", 30)]


def finding(id, key=None, name=None, fid=None, module="a.dll", **more):
    base = dict.fromkeys((c.strip().split(" ")[0] for c in FINDINGS.split(",")))
    return tuple({**base, "id": id, "dedup_key": key, "function_name": name, "function_id": fid, "module": module, **more}.values())


def folder(spark, path, extra=False, **rows):
    """Write every table (empty where no rows are given) and return the folder."""
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        if extra:
            for c in ("load", "bucket", "place", "shard", "g", "s", "k", "key", "run", "child", "pos", "when", "lines", "trust_1", "__m", "__0_load", "first_id", "n_tokens", "category"):
                if c not in df.columns:
                    df = df.withColumn(c, F.lit("clash"))
        df.coalesce(2).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
