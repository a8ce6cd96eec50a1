"""Adapters, reach, discovery, indexes and interfaces on hand-made rows, with nulls, repeats and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalar
from factloom.operators import findings as N
from factloom.operators import indexes as X
from factloom.operators import interfaces as I
from factloom.operators import modules as M
from factloom.operators import relational as R
from factloom.operators.measures import error_stage
from factloom.session import setting


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, " + schema).orderBy("n").select(*cols).collect()]


def test_adapters(spark):
    taint = spark.createDataFrame([("f", "Copy", "mem", "HIGH", 0.9, "x"), (None, None, None, None, None, None)], "function_name string, sink string, sink_category string, severity string, score double, source_type string")
    memory = spark.createDataFrame([("g", "overflow", None, None, None), ("g", None, "Copy", "LOW", 0.1)], "function_name string, category string, dangerous_api string, severity string, score double")
    logic = spark.createDataFrame([("missing_auth", ["a", "b"], "e", "high (likely)"), ("odd", [], "e", None), (None, None, None, "unknown")], "vulnerability_type string, affected_functions array<string>, entry_point string, severity_assessment string")
    n = N.normalised({"taint": taint, "memory_corruption": memory, "logic_vulnerability": logic, "other": taint})
    assert n.columns == list(N.FINDING)
    got = sorted(map(tuple, n.collect()), key=repr)
    assert got == sorted(
        [
            ("f", "taint", "mem", "Copy", "mem", "HIGH", 0.9), ("?", "taint", "", "?", "uncategorized_dangerous", "MEDIUM", 0.3),
            ("g", "memory_corruption", "overflow", "overflow", "memory_unsafe", "MEDIUM", 0.0), ("g", "memory_corruption", "", "Copy", "memory_unsafe", "LOW", 0.1),
            ("a", "logic_vulnerability", "missing_auth", "missing_auth", "logic_unsafe", "HIGH", 0.8), ("e", "logic_vulnerability", "odd", "odd", "logic_unsafe", "MEDIUM", 0.5), ("?", "logic_vulnerability", "", "", "logic_unsafe", "MEDIUM", 0.5),
        ],
        key=repr,
    )
    assert {(r["source_category"], r["sink_category"]) for r in N.for_assessment(n.where("source_type = 'logic_vulnerability'")).collect()} == {("missing_auth", "privilege"), ("odd", "uncategorized_dangerous"), ("", "uncategorized_dangerous")}
    assert N.normalised({"taint": taint.limit(0)}).count() == 0
    with pytest.raises(ValueError):
        N.normalised({"other": taint})


def test_reach(spark):
    rows = [("com_method", True, None, 0, 1), ("com_method", False, "ncacn_http", 4, 1), ("transitive_rpc", False, "ncacn_ip_tcp", None, 4), (None, True, None, None, None), ("rpc_handler", None, "ncalrpc", 1, 0)]
    got = values(spark, rows, "k string, e boolean, p string, g int, h int", F.round(N.reach_score(*map(F.col, "kepgh")), 6))
    assert [r[0] for r in got] == [1.0, 0.5, 0.4675, 0.4, 1.0]
    got = values(spark, [("rpc_handler", 0), ("export", 3), (None, 1), ("internal", None)], "k string, h int", F.round(N.graduated_reach(F.col("k"), F.col("h")), 6))
    assert [r[0] for r in got] == [round(1 / 2**0.5, 6), 0.375, round(0.4 / 2**0.5, 6), round(0.4 / 2**0.5, 6)]
    flags = [(False, True, None, True, True), (None, None, True, True, None), (None, None, None, None, True), (None,) * 5]
    got = values(spark, flags, "a boolean, b boolean, c boolean, d boolean, e boolean", N.reach_context(F.col("a"), F.col("b"), F.lit(None).cast("boolean"), F.col("c"), F.lit(False), F.lit(False), F.col("d"), F.col("e")))
    assert [r[0] for r in got] == ["com_method", "transitive_rpc", "entry_point", None]
    kinds = [("rpc_handler", None, [], None, None, None), ("rpc_handler", None, ["ncalrpc"], "s", None, None), ("rpc_handler", None, ["ncalrpc"], None, "critical", None), ("com_method", None, None, None, None, True), ("com_method", None, None, None, None, None), ("export_dll", "kernel_adjacent", None, None, None, None), (None, None, None, None, None, None)]
    got = values(spark, kinds, "k string, t string, p array<string>, s string, r string, e boolean", N.kind_score(*map(F.col, "ktpsre")))
    assert [r[0] for r in got] == [0.9, 0.75, 0.95, 0.9, 0.7, 0.7, 0.3]
    got = values(spark, [(0.5, "internal", " high"), (1.0, None, None)], "s double, r string, v string", F.round(N.priority(F.col("s"), F.col("r"), F.col("v")), 6))
    assert [r[0] for r in got] == [0.28, 0.08]


def test_discovery(spark):
    t = lambda *rows: spark.createDataFrame(rows, "module string, function_name string, kind string")
    d = N.discovered([("a", t(("m", "f", "x"), ("m", "f", "x"))), ("b", t(("m", "f", "y"), ("m", "g", "z"), ("k", "f", "w"))), ("c", t(("m", "g", "q")).limit(0))])
    assert sorted(tuple(r[c] for c in ("module", "function_name", "kind", "source", "notes")) for r in d.collect()) == [("k", "f", "w", "b", "b"), ("m", "f", "x", "a", "a; b"), ("m", "g", "z", "b", "b")]
    names = lambda *rows: spark.createDataFrame(rows, "module string, name string")
    trust = N.module_trust(names(("a", "DllRegisterServer"), ("b", "f"), ("c", "ServiceMain"), ("e", None)), names(("a", "RpcServerRegisterIf3"), ("b", "RpcServerRegisterIf3"), ("d", "NtDeviceIoControlFile"), ("d", "ZwNtDeviceIoControlFile2"), ("f", None)))
    assert dict(map(tuple, trust.collect())) == {"a": "com_server", "b": "rpc_server", "c": "system_service", "d": "kernel_adjacent", "e": "user_process", "f": "user_process"}
    v = N.verified_by(spark.createDataFrame([("p", 1.0), ("q", 1.0), (None, None)], "c string, s double"), "c", {"p": lambda df: F.when(df["s"] > 0.5, "CONFIRMED")})
    assert [r["confidence"] for r in v.collect()] == ["CONFIRMED", "UNCERTAIN", "UNCERTAIN"]


def test_indexes(spark):
    i = spark.createDataFrame([("m", "ParseHeader", None, True, ["a", "b"]), ("m", "std::sort", "STL", False, ["a"]), ("m", "free", "CRT", None, None), ("k", "Parse", None, None, [])], "module string, name string, library string, has_decompiled boolean, files array<string>")
    assert sorted(map(tuple, X.library_groups(i).collect())) == [("(application)", 2, 1), ("CRT", 1, 0), ("STL", 1, 0)]
    assert sorted(map(tuple, X.index_stats(i).collect())) == [("k", 1, 1, 0, 0, 0, 0), ("m", 3, 1, 2, 1, 2, 2)]
    assert dict(map(tuple, X.noise_ratio(i).collect())) == {"m": 0.6667, "k": 0.0}
    names = lambda *a, **k: sorted(r["name"] for r in X.search_index(i, *a, **k).collect())
    assert names("parse") == ["Parse", "ParseHeader"] and names("s.*t", "regex", lib_only=True) == ["std::sort"] and names("ParseHaeder", "fuzzy") == ["Parse", "ParseHeader"] and names("ParseHaeder", "fuzzy", threshold=0.7) == ["ParseHeader"] and names("(", "regex") == []
    with pytest.raises(ValueError):
        X.search_index(i, "a", "other")
    reg = spark.createDataFrame([("Alpha.dll", "COMPLETE"), ("alpha.exe", "COMPLETE"), ("beta.sys", "PENDING"), ("Gamma.dll", "COMPLETE")], "file_name string, status string")
    w = spark.createDataFrame([(r"C:\x\ALPHA.DLL",), ("alpha",), ("beta.sys",), ("gamma_dll_00ff00ff00.db",), ("delta",), (None,)], "wanted string")
    got = {r["wanted"]: (r["module"], r["how"]) for r in X.resolve_modules(w, reg).collect()}
    assert got == {r"C:\x\ALPHA.DLL": ("Alpha.dll", "exact"), "alpha": (None, "ambiguous"), "beta.sys": ("beta.sys", "incomplete"), "gamma_dll_00ff00ff00.db": ("Gamma.dll", "normal"), "delta": (None, "missing"), None: (None, "missing")}
    t = spark.createDataFrame([('["a token"]',), ('["tok\\u0065n"]',), ('["x"]',), (None,)], "j string")
    assert X.prefiltered(t, "j", "Token").count() == 2


def test_interfaces(spark):
    name = "Microsoft::WRL::Details::RuntimeClassImpl<Microsoft::WRL::RuntimeClassFlags<3>,1,0,0,IA,IB<IC,ID<IE>>,Microsoft::WRL::FtmBase>::Run"
    got = values(spark, [(name,), ("RuntimeClass<RuntimeClassFlags<1>, IA, IB>",), ("Plain::Run",), (None,)], "s string", I.template(F.col("s")))
    assert got[0][0].asDict() == {"flags": 3, "weak": True, "inspectable": False, "interfaces": ["IA", "IB<IC,ID<IE>>"], "free_threaded": True}
    assert got[1][0].asDict() == {"flags": 1, "weak": False, "inspectable": False, "interfaces": ["IA", "IB"], "free_threaded": False} and got[2][0] is None and got[3][0] is None
    base = ["QueryInterface", "AddRef", "Release"]
    got = values(spark, [([*base, "GetIids", "GetRuntimeClassName", "GetTrustLevel"], None), (base, "x"), (["Run", "AddRef", None, "Release"], "x"), (["Run"], "IFoo"), ([], "IFoo"), (None, None)], "m array<string>, c string", I.table_grade(F.col("m"), F.col("c")))
    assert [tuple(r[0]) for r in got] == [("high", "IInspectable", 6), ("high", "IUnknown", 3), ("medium", "IUnknown", 0), ("low", "IUnknown", 0), ("none", None, 0), ("none", None, 0)]
    s = spark.createDataFrame([("m", "class A;", 4), ("m", "class A;", 2), ("k", "class A;", 9), ("m", "", 1), ("m", None, 1)], "module string, skeleton string, function_id int")
    assert sorted(map(tuple, I.first_skeletons(s).collect())) == [("k", "class A;", 9, 1), ("m", "class A;", 2, 2)]
    c = I.class_interfaces(spark.createDataFrame([(name,), (name.replace("IA,", "IZ,"),)], "n string"), "n").collect()
    assert len(c) == 2 and {tuple(r["interfaces"]) for r in c} == {("IA", "IB<IC,ID<IE>>"), ("IB<IC,ID<IE>>", "IZ")}


def test_edges_through_one_node(spark):
    sites = spark.createDataFrame([("A", "C1"), ("b", None), ("c", "gone"), ("s", "c1"), ("A", "c1")], "module string, class_id string")
    servers = spark.createDataFrame([("c1", "s", "open"), ("C1", "s", "close"), ("c2", "t", "run"), (None, "u", "x")], "class_id string, module string, procedure string")
    got = sorted(map(tuple, M.activation_edges(sites, servers).collect()), key=repr)
    any_ = M.ANY_SERVER
    assert got == sorted([("a", "s", "open", "resolved"), ("a", "s", "close", "resolved"), ("b", any_, None, "unresolved"), ("c", any_, None, "unresolved"), (any_, "s", "open", "unresolved"), (any_, "s", "close", "unresolved"), (any_, "t", "run", "unresolved")], key=repr)
    assert M.activation_edges(sites.where("module = 'A'"), servers).where("edge_type = 'unresolved'").count() == 0
    assert M.activation_edges(sites.limit(0), servers).count() == 0


def test_names_and_types(spark):
    got = values(spark, [("void f(int a, std::map<int, char> b, void (*c)(int, int))",), ("f()",), ("f",), (None,)], "s string", scalar.parameter_count(F.col("s")))
    assert [r[0] for r in got] == [3, 0, 0, None]
    got = values(spark, [("byte[]",), ("string[]",), ("NdrPipe<int>",), ("int[]",), ("string",), ("Union_4",), ("odd",), (None,)], "s string", scalar.wire_type_risk(F.col("s")))
    assert [r[0] for r in got] == [0.9, 0.85, 0.75, 0.6, 0.8, 0.6, 0.5, None]
    got = values(spark, [("Logon_Token",), ("OpenFileAsync",), ("ReadFile",), ("zzz",), (None,)], "s string", scalar.method_kind(F.col("s")))
    assert [r[0] for r in got] == ["authentication", "async_operation", "file_io", "other", "other"]
    got = values(spark, [('[{"stage": "a"}]',), ('{"stage": "b"}',), ("[]",), ("broken",), (None,)], "s string", error_stage(F.col("s")))
    assert [r[0] for r in got] == ["a", "b", "none", "none", "none"]


def test_batches_and_settings(spark, monkeypatch):
    df = spark.createDataFrame([(i,) for i in range(25)], "v int").repartition(3)
    assert sorted((r["v"], r["b"]) for r in R.batched(df, [F.col("v")], 10, "b").collect()) == [(i, i // 10) for i in range(25)]
    assert R.batched(df.limit(0), [F.col("v")], 10, "b").count() == 0
    assert setting(spark, "a.b", "x") == "x"
    spark.conf.set("factloom.a.b", "y")
    assert setting(spark, "a.b", "x") == "y"
    monkeypatch.setenv("FACTLOOM_A_B", "z")
    assert setting(spark, "a.b", "x") == "z"
    spark.conf.unset("factloom.a.b")
