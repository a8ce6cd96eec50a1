from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import layouts as L
from factloom.operators import modules as M
from factloom.operators import reports as P


@pytest.fixture(scope="module")
def info(spark):
    f = lambda n, to=None: {"function_name": n, "is_forwarded": to is not None, "forwarded_to": to}
    rows = [
        ("AppInfo.dll", json.dumps([{"name": "AiLaunch"}, {"function_name": "AiCheck"}]), json.dumps([{"module_name": "KERNEL32.dll", "functions": [{"name": "CreateProcessW"}, {"function_name": "CloseHandle"}]}, {"name": "ntdll.dll", "functions": [{"function_name": "NtOpen", "is_delay_loaded": True}]}])),
        ("kernel32.dll", json.dumps([f("CreateProcessW", "kernelbase.CreateProcessW"), f("HeapAlloc", "ntdll.RtlAllocateHeap"), f("GetLastError")]), json.dumps([{"module_name": "ntdll.dll", "functions": [{"name": "NtAlloc"}]}])),
        ("bad.dll", "[{", None),
    ]
    return spark.createDataFrame(rows, "module string, exports string, imports string")


def test_indexes(spark, info):
    e, i = M.export_index(info), M.import_index(info)
    s = M.index_summary(e, i).first()
    assert (s["exports"], s["forwarded"], s["imports"], s["edges"]) == (5, 2, 4, 3)
    assert {r["to_module"] for r in e.where("forwarded").collect()} == {"kernelbase.dll", "ntdll.dll"}
    assert M.who_exports(e, "heapalloc").count() == 1 and M.who_imports(i, "ntopen", "NTDLL.dll").count() == 1
    assert {(r["module"], r["from_module"], r["names"], r["delayed"]) for r in M.dependencies(i).collect()} == {("appinfo.dll", "kernel32.dll", 2, False), ("appinfo.dll", "ntdll.dll", 1, True), ("kernel32.dll", "ntdll.dll", 1, False)}
    assert M.consumers(i, "ntdll.dll").count() == 2 and M.suppliers(i, "AppInfo.dll").count() == 2
    p = spark.createDataFrame([("Nt", "native"), ("Create", "process")], "prefix string, class string")
    assert {(r["module"], r["class"], r["names"]) for r in M.import_analysis(i, p).collect()} == {("appinfo.dll", "process", 1), ("appinfo.dll", "other", 1), ("appinfo.dll", "native", 1), ("kernel32.dll", "native", 1)}
    c = {}
    for r in M.forwarder_chains(e).orderBy("hop").collect():
        c.setdefault(r["start"], []).append(r["node"])
    assert c["kernel32.dll!createprocessw"] == ["kernel32.dll!createprocessw", "kernelbase.dll!createprocessw"]


def test_resolution(spark, info):
    fns = spark.createDataFrame([("alpha", "Shared", 1), ("beta", "SHARED", 2), ("kernel32.dll", "GetLastError", 3), ("kernel32.dll", "getlasterror", 4)], "module string, function_name string, function_id bigint")
    w = spark.createDataFrame([("shared",), ("HeapAlloc",), ("none",)], "name string")
    e = M.export_index(info)
    assert sorted(map(tuple, M.resolved(w, fns, e).collect())) == [("HeapAlloc", "ntdll.dll", "forwarded"), ("shared", "alpha", "defined"), ("shared", "beta", "defined")]
    k = {r["name"]: (r["kind"], r["function_id"]) for r in M.export_functions(e, fns).where("module = 'kernel32.dll'").collect()}
    assert k["GetLastError"] == ("plain", 3) and k["HeapAlloc"] == ("forwarded", None)


def test_calls(spark):
    c = spark.createDataFrame([("a", "b", "F"), ("b", "a", "G"), ("a", "c", "OpenFile"), ("d", "b", "F"), ("b", "b", "F")], "module string, dst_module string, dst string")
    assert sorted(map(tuple, M.shared_functions(c, "A", "B").collect())) == [("a", "b", "F"), ("b", "a", "G")]
    assert M.calling_modules(c, "openf").count() == 1 and M.calling_modules(c, "f", ["D"]).count() == 1
    s = spark.createDataFrame([("b", "F", 0.5), ("a", "H", 0.5)], "module string, name string, score double")
    assert {r["module"]: (r["outside"], r["score"]) for r in M.caller_boost(s, c).collect()} == {"b": (2, 0.6), "a": (0, 0.5)}
    m = spark.createDataFrame([("A",), ("B",)], "module string")
    none = c.select(F.col("module").alias("src_module"), "dst_module").limit(0)
    assert sorted(map(tuple, M.fallback_edges(none, m, m).collect())) == [(M.ANY_SERVER, "a"), (M.ANY_SERVER, "b"), ("a", M.ANY_SERVER), ("b", M.ANY_SERVER)]
    assert M.fallback_edges(c.select(F.col("module").alias("src_module"), "dst_module"), m, m).count() == 5
    o = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("z", 4)], "k string, o int")
    assert [r["o"] for r in M.one_per_category(o, "k", "o", 2).collect()] == [1, 3]


def test_callbacks(spark):
    e = spark.createDataFrame([("reg", "onevent"), ("reg", "helper"), *[(f"c{i}", "helper") for i in range(9)], ("reg", "rare")], "src string, dst string")
    r = spark.createDataFrame([("reg", "SetB", 2), ("reg", "SetA", 1)], "node string, api string, pos int")
    assert sorted(map(tuple, M.callbacks(e, r, "^on").collect())) == [("onevent", "reg", "SetA"), ("rare", "reg", "SetA")]


def test_prefix_classes(spark):
    n = spark.createDataFrame([("NtOpenFile",), ("NtClose",), ("Zz",), (None,), ("NtOpenFile",)], "n string")
    p = spark.createDataFrame([("Nt", "native"), ("NtOpen", "open"), ("NtOpenFileX", "no"), ("", "empty")], "prefix string, class string")
    assert sorted(map(str, [r["class"] for r in M.classified(n, "n", p).collect()])) == ["None", "None", "native", "open", "open"]
    assert M.classified(n, "n", p.limit(0)).where("class IS NULL").count() == 5


def test_layouts(spark):
    code = "x = *(_DWORD *)(a1 + 16); *(_QWORD *)(a1 + 0x20) = 5; v4 = *(len + 22); if ( *(_WORD *)(a2 + 2) == 1 )"
    assert list(L.code_accesses(code)) == [("a1", 16, 4, "read"), ("a1", 32, 8, "write"), ("a2", 2, 2, "read"), ("len", 22, 8, "read")]
    asm = "mov rbx, rcx\nmov dword ptr [rbx+10h], eax\nmov rax, qword ptr [rdx+8]\nmov rcx, [rsp+56h]\nadd eax, [rax+4]\ntest rcx, rcx"
    assert list(L.assembly_accesses(asm)) == [("arg1", 16, 4, "write"), ("arg2", 8, 8, "read")]
    f = spark.createDataFrame([("m", 1, code, asm), ("m", 2, "*(_BYTE *)(a1 + 16) = 1", None), ("m", 3, None, None)], "module string, function_id bigint, decompiled_code string, assembly_code string")
    got = {(r["base"], r["byte_offset"]): (r["size"], r["kinds"], r["sources"], r["verified"]) for r in L.fields(L.accesses(f)).collect()}
    assert got["a1", 16] == (4, "read,write", 2, False) and got["arg1", 16] == (4, "write", 1, True)
    assert {r["confidence"] for r in L.confidence(L.fields(L.accesses(f))).collect()} == {"low", "medium"}
    h = L.headers(L.fields(L.accesses(f), ("base",)), "base").where("base = 'a1'").first()["header"]
    assert h == "struct a1 {\n  uint8_t field_10[4];  // 0x10\n  uint8_t field_20[8];  // 0x20\n};"


def test_classes(spark):
    f = spark.createDataFrame([("??0CTask@app@@QAE@XZ",), ("??1CTask@app@@QAE@XZ",), ("?Run@CTask@app@@QAEXXZ",), ("??_7CTask@app@@6B@",), ("?free@@YAXXZ",), (None,)], "mangled_name string")
    r = L.class_members(f).collect()
    assert [tuple(x) for x in r] == [("app::CTask", 1, 1, 1, 1)]


def test_reports(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "C"), ("C", "api1")], "src string, dst string")
    s = spark.createDataFrame([("A",)], "entry string")
    t = P.topology(e, spark.createDataFrame([(x,) for x in "ABCD"], "node string"), s)
    assert [r[0] for r in t["dead"].collect()] == ["D"] and {r["depth"]: r["n"] for r in t["depths"].collect()} == {0: 1, 1: 2, 2: 1}
    calls = P.transitive_calls(e, s, 1)
    assert {r["name"] for r in calls.collect()} == {"B", "C", "api1"}
    a = P.handler_audit(calls, ["check"], ["api1"]).first()
    assert (a["missing"], a["found"], a["verdict"]) == ("check", "api1", "high")
    k = spark.createDataFrame([("B", "leafy"), ("C", "danger")], "node string, kind string")
    from factloom.operators.graph import reach

    plan = {r["depth"]: (r["danger"], r["other"]) for r in P.traversal_plan(reach(e, s, 2), k, ["danger"]).collect()}
    assert plan == {0: (0, 1), 1: (1, 1), 2: (0, 1)}
    tree = P.call_tree(e.withColumn("dst_module", F.when(F.col("dst") == "api1", "k32").otherwise("")), s, 3)
    assert {(r["parent"], r["child"], r["depth"], r["kind"]) for r in tree.collect()} == {("A", "B", 1, "internal"), ("A", "C", 1, "internal"), ("C", "api1", 2, "external")}
    d = P.dossier(e, s, spark.createDataFrame([("api1", "x")], "node string, api string"), "B")
    assert d["callers"].count() == 2 and d["nearest_entry"].first()["source"] == "A" and d["danger"].first()["first_depth"] == 2


def test_cross_module(spark):
    calls = spark.createDataFrame([("a", "F", "", "G"), ("a", "G", "B.dll", "H"), ("b.dll", "H", "", "I"), ("c", "P", None, "Q")], "module string, src string, dst_module string, dst string")
    ipc = spark.createDataFrame([("B.dll", "c", "P")], "src_module string, dst_module string, procedure string")
    r = P.cross_module_reach(calls, ipc, spark.createDataFrame([("a!F",)], "entry string"), 6)
    assert {(x["module"], x["name"]) for x in r.collect()} == {("a", "F"), ("a", "G"), ("b.dll", "H"), ("b.dll", "I"), ("c", "P"), ("c", "Q")}
