from __future__ import annotations

import json

import pytest

from factloom.plans.identity import identified
from factloom.plans.problems import QUERIES
from tests.fixture_tables import FUNCTION_ROWS, TERMS, finding, folder


def rows():
    guards = json.dumps([{"checks": {"v": 1}}, None])
    return [finding(i, name=n, module=m, guards_json=guards if i == 0 else None) for i, (n, m) in enumerate([("__imp_RUN ", "C:\\x\\A.DLL"), ("run", "a.dll"), ("Run", " a.dll "), ("nope", "a.dll"), (None, "a.dll"), ("open", None), ("open", ""), ("open", "B.EXE"), ("?", "a.dll")])]


@pytest.mark.parametrize("extra", [False, True])
def test_pairs(spark, tmp_path, extra):
    d = folder(spark, tmp_path, extra, findings=rows() + rows(), module_functions=FUNCTION_ROWS)
    assert {(r["module"], r["function_name"]): r["n"] for r in QUERIES["p2_pairs"](spark, d).collect()} == {("a.dll", "Run"): 6, ("b.exe", "Open"): 2}
    assert sorted(map(tuple, QUERIES["p2_found"](spark, d).collect())) == [("a.dll", "Run"), ("b.exe", "Open")]
    assert sorted(map(tuple, QUERIES["p5_found"](spark, d).collect())) == [(0, "check", 0, 0)] * 2 + [(0, "guard", -1, 0)] * 2


def test_share_is_strict(spark, tmp_path):
    d = folder(spark, tmp_path, findings=[finding(i, name="Run") for i in range(1)] + [finding(i + 1, name=None) for i in range(99)], module_functions=FUNCTION_ROWS)
    assert QUERIES["p2_found"](spark, d).count() == 0  # exactly 1 % isn't more


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, tmp_path, name):
    assert QUERIES[name](spark, folder(spark, tmp_path)).count() == 0


def test_identity(spark, tmp_path):
    def f(id, key, **more):
        return finding(id, key, **more)

    made = [
        f(1, "3::VaultOpen::type_mixup"), f(2, "0x3 :: vaultopen() :: TYPE MIXUP"), f(3, "a.dll::3::__imp_VaultOpen::type_mixpu"), f(4, "OPEN::VaultOpen::type-mixup"),
        f(5, "", fid=3, sink="VaultOpen", source_category="type_mixup"), f(6, None, fid=3, sink="vautlopen", source_category="type mixup"),
        f(7, "run::VaultOpen::type_mixup"), f(8, "3::VaultOpenE::sign_flip"), f(9, "3::VaultOpen"), f(10, "3::zzzzzz::type_mixup"), f(11, "3::VaultOpen::type_mixup", module=""),
        f(12, None, sink="VaultOpen", source_category="type_mixup"), f(13, "3::VaultOpenEx::type_mixup"),
    ]
    d = folder(spark, tmp_path, True, findings=made, module_functions=FUNCTION_ROWS, taxonomy=TERMS)
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    got = {r["id"]: (r["module"], r["function_id"], r["sink"], r["category"]) for r in identified(read("findings"), read("module_functions"), read("taxonomy")).collect()}
    same = ("a.dll", 3, "VaultOpen", "type_mixup")
    assert {i for i, x in got.items() if x == same} == {1, 2, 3, 4, 5, 6}
    assert got[13] == ("a.dll", 3, "VaultOpenEx", "type_mixup") and got[8][3] == "sign_flip"
    assert not {7, 9, 10, 11, 12} & set(got)
