from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import catalogs as C

A, B, D = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222", "33333333-3333-3333-3333-333333333333"


@pytest.fixture(scope="module")
def binaries(spark):
    cat = {
        "C:\\s\\Svc.dll": {
            "binary_path": "C:\\s\\Svc.dll",
            "interfaces": [
                {"interface_id": A, "procedure_count": 3, "offset": 1000, "is_client": False, "service_name": "S", "is_service_running": True, "endpoints": ["ncalrpc:[x]"]},
                {"interface_id": B, "procedure_count": 2, "offset": 2000, "is_client": False, "service_name": "S", "endpoints": ["ncacn_ip_tcp:5"]},
            ],
            "procedures": ["PA", "PB", "0x180001000", "PC", "PD", "PE", "PF"],
        },
        "other.exe": {"binary_path": "other.exe", "interfaces": [{"interface_id": D, "procedure_count": 0, "offset": 1, "is_client": False}, {"interface_id": A, "procedure_count": 0, "offset": 2, "is_client": True}], "procedures": []},
    }
    return C.binaries(spark.createDataFrame([(json.dumps(cat),), ("broken {",), (None,)], "j string"), "j")


def test_interfaces(binaries):
    i = C.interfaces(binaries)
    assert {(r["module"], r["interface_id"][0]): r["tier"] for r in i.collect()} == {("svc.dll", "1"): "medium", ("svc.dll", "2"): "critical", ("other.exe", "3"): "low", ("other.exe", "1"): "low"}
    assert {r["tier"]: r["n"] for r in C.by_tier(i).collect()} == {"medium": 1, "critical": 1, "low": 2}
    assert {r["service"]: r["n"] for r in C.by_service(i).collect()} == {"S": 2, "(no service)": 2}
    t = {r["interface_id"][0]: (r["servers"], r["clients"]) for r in C.topology(i).collect()}
    assert t["1"] == (["svc.dll"], ["other.exe"]) and t["3"] == (["other.exe"], [])
    assert {(r["interface_id"][0], r["sibling"][0]) for r in C.blast_radius(i, i.where(F.col("interface_id") == A)).collect()} == {("1", "2"), ("1", "3")}


def test_procedures(binaries):
    p = C.procedures(binaries)
    assert sorted((r["interface_id"][0], r["procedure"]) for r in p.collect()) == [("1", "PA"), ("1", "PB"), ("1", "PC"), ("2", "PD"), ("2", "PE")]
    e = C.client_edges(C.interfaces(binaries), p)
    assert {(r["src_module"], r["dst_module"], r["procedure"]) for r in e.collect()} == {("other.exe", "svc.dll", x) for x in ("PA", "PB", "PC")}


def test_strings(spark, binaries):
    s = spark.createDataFrame([(f"see {A.upper()} and {B}",), ("ncalrpc:[X]",), ("none",), (None,)], "s string")
    got = sorted((r["interface_id"][0], r["how"]) for r in C.in_strings(s, "s", C.interfaces(binaries)).collect())
    assert got == [("1", "endpoint"), ("1", "uuid"), ("1", "uuid"), ("2", "uuid")] or got == [("1", "endpoint"), ("1", "uuid"), ("2", "uuid")]


def test_descriptors(spark):
    df = spark.createDataFrame([("O:BAG:BAD:(A;;GA;;;WD)(D;;GA;;;BA)",), ("D:(A;;GA;;;WD)(D;;GA;;;WD)",), ("D:(A;;GR;;;SY)",), (None,)], "s string")
    assert [r[0] for r in df.select(C.permissive(F.col("s"))).collect()] == [True, False, False, False]
    a = df.select(C.aces(F.col("s"))).first()[0]
    assert [(x["kind"], x["rights"], x["sid"]) for x in a] == [("A", "GA", "WD"), ("D", "GA", "BA")]


def test_privileged(spark):
    servers = spark.createDataFrame([("a",), ("b",)], "server string")
    ctx = spark.createDataFrame([("a", "low", True), ("b", "low", False), ("b", "high", True)], "server string, caller string, privileged boolean")
    assert [r[0] for r in C.privileged(servers, ctx, "low").collect()] == ["a"]


def test_servers(spark):
    m = spark.createDataFrame([("OpenFile",), ("close",)], "name string")
    assert C.methods_matching(m, "name", "^open").count() == 1 and C.methods_matching(m, "name", "(").count() == 0
    ctx = spark.createDataFrame([("a", "low", True, False), ("a", "high", False, False), ("b", "high", True, True), ("c", "low", False, False)], "server string, caller string, privileged boolean, remote boolean")
    assert {r["server"]: r["tier"] for r in C.best_tier(ctx).collect()} == {"a": "high", "b": "critical", "c": "low"}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(C.flag_score([(F.lit(True), 0.5), (F.lit(None).cast("boolean"), 0.4)], F.lit(10), F.lit(3))) == 0.55 and one(C.flag_score([(F.lit(True), 0.5)], F.lit(3), F.lit(3))) == 0
