from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.operators.nested import EACH, EMPTY, FINDING_CHILDREN, Child, Flattener, NotJson, child_tables, parse_through, scan, triple_table, triples

values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(), c, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(values, st.sampled_from([None, 2]))
def test_scan_reads_what_json_writes(v, indent):
    assert scan(json.dumps(v, indent=indent)) == v


@settings(max_examples=100, deadline=None)
@given(values)
def test_scan_refuses_cut_texts(v):
    t = json.dumps(v)
    if isinstance(v, (dict, list, str)):
        with pytest.raises(ValueError):
            scan(t[:-1])
    with pytest.raises(ValueError):
        scan(t + " ,")


def rebuilt(rows):
    """The value that triples came from (without the order of keys)."""
    rows = list(rows)
    if len(rows) == 1 and rows[0][0] == ():
        return {} if rows[0][2] is EMPTY else rows[0][2]
    heads = {p[0] for p, _, _ in rows}
    if heads == {EACH}:
        n = max(o[0] for _, o, _ in rows) + 1
        return [rebuilt([(p[1:], o[1:], v) for p, o, v in rows if o[0] == i]) for i in range(n)]
    return {h: rebuilt([(p[1:], o, v) for p, o, v in rows if p[0] == h]) for h in heads}


plain = st.recursive(st.none() | st.integers() | st.text("ab", max_size=3), lambda c: st.lists(c, min_size=1, max_size=3) | st.dictionaries(st.text("xyz", min_size=1, max_size=2), c, max_size=3), max_leaves=15)


@settings(max_examples=200, deadline=None)
@given(plain)
def test_triples_round_trip(v):
    assert rebuilt(triples(v, frozenset())) == v


def rows(column, text):
    return sorted(x[:3] for x in Flattener(FINDING_CHILDREN[column]).rows(text))


def test_children():
    g = json.dumps([{"guard_type": "a", "checks": [None, {"v": 1}]}, None, {"checks": {"v": 2}}, {"conditions": [{"v": 3}]}, {"_truncated": True}, {}, "text"])
    assert rows("guards_json", g) == [("check", 0, 1), ("check", 2, 0), ("check", 3, 0), ("guard", -1, 0), ("guard", -1, 2), ("guard", -1, 3), ("guard", -1, 5), ("guard", -1, 6)]
    assert rows("guards_json", json.dumps({"checks": []})) == [("guard", -1, 0)]
    assert rows("guards_json", json.dumps([{"checks": [], "conditions": [{"v": 1}]}])) == [("guard", -1, 0)]
    assert rows("path_json", '"[\\"a\\",\\"b\\"]"') == [("step", -1, 0), ("step", -1, 1)]
    assert rows("path_json", '"lone"') == [("step", -1, 0)]
    x = json.dumps({"affected_functions": "f", "mitigations_present": [None, {"n": 1}], "data_flow": {"hops": [{"refs": "r"}, {"refs": None}, {"_truncated": True}, {"refs": ["p", None, "q"]}]}})
    assert rows("extra_json", x) == [("affected", -1, 0), ("hop", -1, 0), ("hop", -1, 1), ("hop", -1, 3), ("mitigation", -1, 1), ("ref", 0, 0), ("ref", 3, 0), ("ref", 3, 2)]
    assert rows("extra_json", json.dumps({"data_flow": "x reaches y"})) == []


@pytest.mark.parametrize("text", [None, "", "  ", "null", "NULL", "<omitted>", "[1, 2", '"[1, 2"', "[1] x", "[NaN]", "[]", "{}"])
def test_no_children(text):
    assert rows("path_json", text) == ([("step", -1, 0)] if text == "{}" else [])


def test_any_depth():
    deep = "[" * 100_000 + "]" * 100_000
    v = parse_through(deep)
    n = 0
    while v:
        v, n = v[0], n + 1
    assert n == 99_999
    assert list(Flattener((Child("step", (EACH,)),)).rows('{"a":' * 50_000 + "1" + "}" * 50_000))[0][:3] == ("step", -1, 0)
    with pytest.raises(NotJson):
        scan("[" * 1000)


def test_table(spark):
    df = spark.createDataFrame([(1, '[{"a": 1}]', "x"), (2, None, "y"), (1, '[{"a": 1}]', "x")], "id bigint, path_json string, child string")
    got = child_tables(df, "id", {"path_json": FINDING_CHILDREN["path_json"]}, fields=True).collect()
    assert [(r["id"], r["child"], r["parent_pos"], r["pos"], r["fields"]) for r in got] == [(1, "step", -1, 0, {"a": "1"})] * 2
    assert child_tables(df.limit(0), "id", {"path_json": FINDING_CHILDREN["path_json"]}).count() == 0
    assert {(r["path"], tuple(r["ordinals"]), r["value"]) for r in triple_table(df, "id", "path_json").collect()} == {("*.a", (0,), "1")}


def test_fields_and_triples_of_made_rows(spark, tmp_path):
    import json

    from factloom.plans.problems import QUERIES
    from tests.fixture_tables import finding, folder

    extra = {"affected_functions": ["a", None, {"name": "b", "line": 3}], "data_flow": {"hops": [{"at": "1", "refs": ["x", {"to": "y"}]}, {"_truncated": True}, {"at": "2", "refs": []}], "mode": "fw"}}
    rows = [finding(1, extra_json=json.dumps(extra), guards_json='{"guard_type": "canary", "checks": ["p", {"q": 1}]}'), finding(2, extra_json='{"a": [1, [2, {"b": null}]], "c": {}}'), finding(3, extra_json='{"a": 1'), finding(4), finding(5, extra_json="")]
    d = folder(spark, tmp_path, True, findings=rows)
    got = sorted(tuple(r) for r in QUERIES["p5_fields"](spark, d).select("id", "child", "parent_pos", "pos", "field", "value").collect())
    assert got == sorted(
        [
            (1, "affected", -1, 0, "", "a"), (1, "affected", -1, 2, "name", "b"), (1, "affected", -1, 2, "line", "3"), (1, "hop", -1, 0, "at", "1"), (1, "hop", -1, 2, "at", "2"),
            (1, "ref", 0, 0, "", "x"), (1, "ref", 0, 1, "to", "y"), (1, "guard", -1, 0, "guard_type", "canary"), (1, "check", 0, 0, "", "p"), (1, "check", 0, 1, "q", "1"),
        ]
    )
    got = sorted((r["path"], r["ordinals"], r["value"]) for r in QUERIES["p5_triples"](spark, d).where("id = 2").select("path", "ordinals", "value").collect())
    assert got == [("a.*", "0", "1"), ("a.*.*", "1.0", "2"), ("a.*.*.b", "1.1", None), ("c", "", None)]
    assert sorted(r["id"] for r in QUERIES["p5_triples"](spark, d).select("id").distinct().collect()) == [1, 2]


NESTED = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.floats(-5, 5) | st.sampled_from(["", "a", "[", "{x", '["q", {"checks": [1]}]', '{"a": [1, null]}', " [2]", "null", '"s"', 'é"\\']),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["checks", "conditions", "sites", "a", "_truncated"]), x, max_size=4),
    max_leaves=14,
)


@settings(max_examples=500, deadline=None)
@given(NESTED, st.booleans(), st.integers(0, 3))
def test_a_stream_gives_the_same_rows(value, wrapped, cut_off):
    from factloom.operators import nested as M

    text = json.dumps(json.dumps(value) if wrapped else value, ensure_ascii=wrapped)
    text = text[: len(text) - cut_off]
    for children in M.FINDING_CHILDREN.values():
        f = M.Flattener(children)
        rows = lambda: sorted(repr((*r[:3], sorted(map(repr, r[3].items())))) for r in f.rows(text))  # noqa: B023, E731
        want = rows()
        before, M.STREAMED = M.STREAMED, -1
        try:
            assert rows() == want
        finally:
            M.STREAMED = before


@pytest.mark.parametrize("text", ["[1,]", "[,1]", "{,}", '{"a" 1}', '{"a":}', '{"a":1,}', "[1 2]", "[1]]", "1 2", "[", "]", "{", "}", ":", ",", '["a":1]', "{1:2}", "nul", "[01]", '{"a":1 "b":2}', '["a" "b"]', "", " "])
def test_a_stream_refuses_what_is_no_json(text):
    from factloom.operators import nested as M

    with pytest.raises(ValueError):
        json.loads(text)
    with pytest.raises(ValueError):
        list(M.streamed(text, frozenset()))


def test_long_texts_are_streamed(spark):
    from factloom.operators import nested as M

    guards = [{"guard_type": f"g{i}", "checks": [{"q": i}] * (i % 3)} for i in range(5000)]
    df = spark.createDataFrame([(1, json.dumps(guards))], "id bigint, guards_json string")
    got = M.child_tables(df, "id", {"guards_json": M.FINDING_CHILDREN["guards_json"]}).groupBy("child").count().collect()
    assert {r["child"]: r["count"] for r in got} == {"guard": 5000, "check": sum(i % 3 for i in range(5000))}
