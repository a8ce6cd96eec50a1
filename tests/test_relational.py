from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.model import has_value, json_or_empty, parsed_functions, untruncated, XREFS
from factloom.operators import relational as R
from factloom.operators import scoring as SC
from factloom.operators import store
from factloom.functions import cleaning, scalar


def test_has_value(spark):
    df = spark.createDataFrame([(None,), ("",), ("[]",), ("null",), ("[1]",), ("{}",)], "j string")
    assert [r[0] for r in df.where(has_value("j")).collect()] == ["[1]", "{}"]
    assert [r[0] for r in df.where(has_value("j", lists=False)).collect()] == ["[]", "[1]", "{}"]


def test_truncated_marker(spark):
    df = spark.createDataFrame([('[{"name": "a"}, {"_truncated": true}]',), ("broken [",), (None,)], "j string")
    assert [r[0] for r in df.select(F.size(untruncated(json_or_empty("j", XREFS)))).collect()] == [1, 0, 0]


@pytest.mark.parametrize("sql", ["DELETE FROM t", "SELECT 1; DROP TABLE t", "select 1; select 2", "PRAGMA x", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"])
def test_writes_are_refused(sql):
    with pytest.raises(ValueError):
        R.read_only_sql(sql)


def test_reads_are_let_through():
    for sql in ("SELECT 'delete' AS x -- drop\n", "with a as (select 1) select * from a;", 'SELECT "update" FROM t'):
        assert R.read_only_sql(sql) == sql


def test_escape_like(spark):
    df = spark.createDataFrame([("50%_x",), ("50abx",)], "t string")
    assert df.where(F.col("t").like(R.escape_like("50%_x"))).count() == 1


def test_filters(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert R.by_filters(df, {}).count() == 0 and R.by_filters(df, {"k": "a", "v": 1}).count() == 1
    with pytest.raises(ValueError):
        R.by_filters(df, {"x": 1})
    with pytest.raises(ValueError):
        R.one_column(df, "nope")
    rows, n = R.page(df, [F.col("k")], 0, 0)
    assert n == 2 and rows.count() == 2
    assert R.page(df, [F.col("k")], 2, 1)[0].first()["k"] == "b"


def test_ranked_over_many_parts(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = {r["v"]: r["rank"] for r in R.ranked(df, [F.desc("v")]).collect()}
    assert got == {v: 1000 - v for v in range(1000)}
    assert R.ranked(df.limit(0), [F.col("v")]).count() == 0


def test_first_wins_with_notes(spark):
    df = spark.createDataFrame([("f", 2, "b", "late"), ("f", 1, "a", "early"), ("g", 3, "c", "only")], "name string, prio int, kind string, note string")
    got = {r["name"]: (r["prio"], r["kind"], r["note"]) for r in R.first_by_priority(df, ["name"], "prio", "note").collect()}
    assert got == {"f": (1, "a", "early; late"), "g": (3, "c", "only")}


def test_gaps_use_the_furthest_end(spark):
    df = spark.createDataFrame([("t", 0, 16), ("t", 4, 2), ("t", 20, 4)], "t string, o int, s int")
    got = sorted((r["o"], r["s"], r["is_gap"]) for r in R.with_gaps(df, "t", "o", "s").collect())
    assert got == [(0.0, 16.0, False), (4.0, 2.0, False), (16.0, 4.0, True), (20.0, 4.0, False)]


def test_compare(spark):
    a = spark.createDataFrame([(1, " x ", None), (2, "y", "p")], "k int, a string, b string")
    b = spark.createDataFrame([(1, "x", None), (2, None, "q"), (3, "z", None)], "k int, a string, b string")
    got = {(r["k"], r["field"]): r["verdict"] for r in R.field_compare(a, b, "k", ["a", "b"]).collect()}
    assert got == {(1, "a"): "ok", (1, "b"): "ok", (2, "a"): "missing", (2, "b"): "differs", (3, "a"): "missing", (3, "b"): "ok"}
    v = {r["k"]: r["verdict"] for r in R.full_compare(a, b, ["k"], "a").collect()}
    assert v == {1: "differs", 2: "differs", 3: "only_right"}


def test_limits():
    assert R.adaptive_limit(50, 5, 50) == 5 and R.adaptive_limit(10_000, 5, 50) == 50 and R.adaptive_limit(300, 3, 50, entries=40) == 20


def test_upsert(spark):
    s = "k string, score double, severity string, status string, updated int"
    old = spark.createDataFrame([("a", 0.4, "LOW", "open", 1), ("b", 0.9, "HIGH", "open", 1), ("c", 0.5, "LOW", "open", 1), ("d", None, "LOW", "open", 1)], s)
    new = spark.createDataFrame([("a", 0.9, "CRITICAL", "new", 2), ("b", 0.3, "LOW", None, 2), ("c", 0.5, "HIGH", "same", 2), ("d", 0.0, "HIGH", "zero", 2), ("e", 0.1, "LOW", "x", 2)], s)
    got = {r["k"]: tuple(r)[1:] for r in store.upsert(old, new, "k", "score", ["status", "updated"]).collect()}
    assert got == {"a": (0.9, "CRITICAL", "new", 2), "b": (0.9, "HIGH", None, 2), "c": (0.5, "LOW", "same", 2), "d": (None, "LOW", "zero", 2), "e": (0.1, "LOW", "x", 2)}
    again = store.upsert(store.upsert(old, new, "k", "score", ["status", "updated"]), new, "k", "score", ["status", "updated"])
    assert {r["k"]: tuple(r)[1:] for r in again.collect()} == got


def test_folded_is_one_by_one(spark):
    s = "k string, score double, severity string, status string, seq int"
    rows = [("a", 0.4, "L", "s1", 1), ("a", 0.9, "C", "s2", 2), ("a", 0.9, "X", "s3", 3), ("a", 0.1, "Y", None, 4), ("b", None, "N", "t", 5)]
    one = store.folded(spark.createDataFrame(rows, s), "k", "score", "seq", ["status"]).collect()
    assert {r["k"]: (r["score"], r["severity"], r["status"]) for r in one} == {"a": (0.9, "C", None), "b": (None, "N", "t")}


def test_store_changes(spark):
    old = spark.createDataFrame([("a", 0.4, "open"), ("b", None, "open")], "k string, score double, verification_status string")
    ch = spark.createDataFrame([("a", "DONE", 0.2), ("b", "DONE", 0.3)], "k string, verification_status string, score double")
    assert {r["k"]: (r["score"], r["verification_status"]) for r in store.verified(old, ch, "k").collect()} == {"a": (0.4, "DONE"), "b": (0.3, "DONE")}
    c2 = spark.createDataFrame([("a", None)], "k string, score double")
    assert {r["k"]: r["score"] for r in store.overwritten(old, c2, "k", ["score"]).collect()} == {"a": 0.4, "b": None}
    kept, gone = store.purged(spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id int, at int"), "at", F.lit(6))
    assert (sorted(r[0] for r in kept.collect()), [r[0] for r in gone.collect()]) == ([2, 3], [1])


def test_paths(spark):
    df = spark.createDataFrame([("k", ["a", "b"], 0.5, 1), ("k", ["b", "a"], 0.9, 2), ("k", ["c"], 0.1, 3), ("k", ["d"], 0.2, 4), ("k", ["e"], 0.3, 5)], "k string, path array<string>, score double, id int")
    got = store.top_paths(df.withColumn("sig", store.path_signature(F.col("path"))), "k", "sig", "score", "id").collect()
    assert sorted(r["id"] for r in got) == [2, 4, 5]


def test_scalars(spark):
    one = lambda col, **kw: spark.range(1).select(*[F.lit(v).alias(k) for k, v in kw.items()] or ["id"]).select(col).first()[0]
    assert one(scalar.severity(F.col("s")), s=0.8) == "CRITICAL" and one(scalar.severity(F.col("s")), s=0.1) == "LOW" and one(scalar.severity(F.col("s")), s=float("nan")) is None
    assert one(scalar.strip_import(F.col("n")), n="__imp_j_x") == "j_x"
    assert one(scalar.aligned(F.col("o"), F.col("z")), o=5, z=4) == 8
    assert one(scalar.bypass(F.array(F.lit("hard"), F.lit("easy")))) == 0.5 and one(scalar.bypass(F.array().cast("array<string>"))) == 1.0
    assert one(scalar.inferred_parameters(F.col("c")), c="x(a1, a12, ba3)") == 12
    assert one(scalar.parameter_count(F.col("c")), c="int f(void *a, int b)") == 2 and one(scalar.parameter_count(F.col("c")), c="int f()") == 0
    assert one(scalar.balanced_arguments(F.col("c")), c='f(g(1, 2), "a,b", x[1,2])') == ["g(1, 2)", '"a,b"', "x[1,2]"]
    assert one(scalar.balanced_arguments(F.col("c")), c="f()") == [] and one(scalar.balanced_arguments(F.col("c")), c="f(a") is None
    m = one(scalar.mangled_parts(F.col("n")), n="?Run@CTask@core@app@@QAEXXZ")
    assert (m["class_name"], m["namespaces"], m["method"], m["role"]) == ("CTask", ["app", "core"], "Run", "method")
    assert one(scalar.mangled_parts(F.col("n")), n="??1CTask@@QAE@XZ")["role"] == "destructor" and one(scalar.mangled_parts(F.col("n")), n="plain")["role"] is None
    assert one(scalar.safe_name(F.col("n")), n="  ../a b?") == "a_b" and one(scalar.truncated(F.col("n"), 5), n="abcdefgh") == "ab..."
    assert one(scalar.calls_in(F.col("c")), c="int f(int a)\n{ if (x) return A::g(h(1)); }") == ["A::g", "h"]


def test_cleaning(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c).first()[0]
    x = F.col("x")
    for v, want in (("C:\\a\\B.DLL", "b.dll"), (" d:/x/y.Sys ", "y.sys"), ("", None), ("  ", None), (None, None), ("dir/", None)):
        assert one(cleaning.module_key(x), v) == want
    for v, want in (("1500000000.5", 1500000000500000), ("2025-01-01 00:00:00", 1735689600000000), ("2025-01-01T00:00:00Z", 1735689600000000), ("2025-01-01T05:30:00+05:30", 1735689600000000), ("2025-01-01", 1735689600000000), ("soon", None), ("12:30", None), ("", None), (None, None)):
        assert one(cleaning.micros(x), v) == want
    for v, want in (("0x1F", 31), (" 12 ", 12), ("x1", None), ("0x", None), (None, None)):
        assert one(cleaning.function_number(x), v) == want
    terms = ["VaultOpen", "VaultOpenEx", "StreamPullA", "StreamPullW"]
    for v, want in (("vault open", "VaultOpen"), ("__imp_VaultOpenEx()", "VaultOpenEx"), ("StreamPulAl", "StreamPullA"), ("VaultOpnEx", "VaultOpenEx"), ("nothing like it", None), ("?", None), (None, None)):
        df = spark.createDataFrame([(v,)], "x string").select(cleaning.term_slug(x).alias("s"))
        assert df.select(cleaning.nearest_term(F.col("s"), terms)).first()[0] == want


def test_scoring(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 4, 3)], "id int, danger int, depth int")
    got = {r["id"]: r["score"] for r in SC.entry_score(df, "id", "danger", "depth", F.lit(1.0)).collect()}
    assert got == {1: 0.4, 2: 0.5875}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(SC.assessment(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit("HIGH"))) == 0.85
    assert one(SC.interest(F.lit(9), F.lit(2), F.lit(5), F.lit(4), F.lit(True), F.lit(1))) == 6
    assert one(SC.verified_score(F.lit(0.8), F.lit("LIKELY"), F.lit(True))) == 0.56 and one(SC.verified_score(F.lit(0.8), F.lit("CONFIRMED"), F.lit(False))) == 0
    w = spark.createDataFrame([(1, "a", 2.0, 0), (1, "b", 1.0, 1), (1, "b", 1.0, 2)], "f int, c string, w double, o int")
    assert SC.best_category(w, ["f"], "c", "w", "o").first()["c"] == "a"
    f = spark.createDataFrame([("HIGH", 0.5)] * 5, "sev string, s double")
    assert SC.deepen(f, "sev", "s").first()[0] and not SC.deepen(f.limit(2), "sev", "s").first()[0]


def test_parsed_functions_of_nothing(spark):
    cols = "module_id string, function_id bigint, function_name string, function_signature string, mangled_name string, decompiled_code string, assembly_code string, simple_outbound_xrefs string, simple_inbound_xrefs string, global_var_accesses string, dangerous_api_calls string, string_literals string, loop_analysis string, stack_frame string, vtable_contexts string"
    assert parsed_functions(spark.createDataFrame([], cols)).count() == 0
    r = parsed_functions(spark.createDataFrame([tuple([None] * 15)], cols)).first()
    assert r["outbound"] == [] and r["loops"] is None


def test_signatures(spark):
    one = lambda col, v: spark.createDataFrame([(v,)], "x string").select(col).first()[0]
    x = F.col("x")
    got = one(scalar.signature_parameters(x), "int f(void *a1, std::map<int, char> m, const char **p, void)")
    assert [tuple(r) for r in got] == [("void *", "a1"), ("std::map<int, char>", "m"), ("const char **", "p")]
    assert one(scalar.signature_parameters(x), "int f(") is None and one(scalar.signature_parameters(x), "int f()") == [] and one(scalar.signature_parameters(x), None) is None
    s = one(scalar.parameter_surface(x), "int f(void *buf, size_t n, IFoo *p)")
    assert s["buffer"] and s["length"] and s["interface"] and not s["text"]
    assert one(scalar.assigned_from(x, "Get"), "a = Get(1); b = (int)Get (2); c = Got(3); a = Get(4)") == ["a", "b"]
    assert one(scalar.first_matching(x, [("time", "timed? ?out"), ("memory", "alloc")]), "Allocation failed") == "memory" and one(scalar.first_matching(x, []), "y") == "other"


def test_safe_select(spark):
    assert R.safe_select(spark, "SELECT id FROM range(5) WHERE id > :least", {"least": 2}).count() == 2
    with pytest.raises(ValueError):
        R.safe_select(spark, "DROP TABLE x")
