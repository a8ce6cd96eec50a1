"""Search queries on hand-made functions."""

from __future__ import annotations

import json

import pytest

from factloom.plans.graphs import QUERIES

COLUMNS = ["function_name", "function_signature", "mangled_name", "decompiled_code", "assembly_code", "simple_outbound_xrefs", "simple_inbound_xrefs", "global_var_accesses", "dangerous_api_calls", "string_literals", "loop_analysis", "stack_frame", "vtable_contexts"]


def test_fuzzy_over_all_dimensions(spark, tmp_path):
    made = [
        dict(function_name="ParseHeader"),
        dict(function_name="q", function_signature="void ParseHeader(int)"),
        dict(function_name="q", string_literals=json.dumps(["zzz", "PareHeader"])),
        dict(function_name="q", simple_outbound_xrefs=json.dumps([{"function_name": "ParseHeader"}])),
        dict(function_name="q", dangerous_api_calls=json.dumps(["ParseHeaderEx"])),
        dict(function_name="ParseHeader", string_literals=json.dumps(["ParseHeaders"]), function_signature="int ParseHeader()"),
        dict(function_name="q", vtable_contexts=json.dumps([{"reconstructed_classes": ["ParseHeader"]}])),
        dict(function_name="q"),
    ]
    schema = ", ".join(["module_id string", "function_id bigint", *(f"{c} string" for c in COLUMNS)])
    spark.createDataFrame([("A.dll", i, *(f.get(c) for c in COLUMNS)) for i, f in enumerate(made)], schema).write.parquet(f"{tmp_path}/module_functions.parquet")
    got = {r["id"]: (r["dim"], r["dims"], r["score"]) for r in QUERIES["search_fuzzy"](spark, str(tmp_path)).collect()}
    near = round(0.5 * (0.3 + 0.25 * 20 / 21) + 0.15, 4)
    want = {0: ("name", 1, 0.65), 1: ("signature", 1, 0.45), 2: ("string", 1, near), 3: ("api", 1, 0.65), 4: ("dangerous", 1, 0.625), 5: ("name", 3, 0.8), 6: ("class", 1, 0.65)}
    assert {i: x[:2] for i, x in got.items()} == {i: x[:2] for i, x in want.items()}
    assert {i: x[2] for i, x in got.items()} == pytest.approx({i: x[2] for i, x in want.items()})
