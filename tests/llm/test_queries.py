from __future__ import annotations

import datetime as dt

import pytest

from factloom.llm.queries import QUERIES
from tests.fixture_tables import FUNCTION_ROWS, TERMS, TRUST, finding, folder


def day(n):
    return dt.datetime(2025, 1, n, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module", params=[False, True])
def d(request, spark, tmp_path_factory):
    key = "3::VaultOpen::type_mixup"
    f = [
        finding(10, key, "Open", 3, score=0.5, verification_status="likely ", updated_at="2025-01-03", evidence_lines_json='["a", " "]', run_id="R2 ", created_at="2025-01-05T00:00:00Z", summary="one two three four five six seven eight nine eleven"),
        finding(11, "OPEN::vaultopen()::type mixup", "open", None, score=0.5, verification_status="Confirmed", updated_at=None, evidence_lines_json='"[\\"a\\", \\"b\\"]"', run_id="r1", created_at="1735689600.5"),
        finding(12, None, " j_Open", 3, score=0.9, sink="VaultOpen", source_category="type_mixup", verification_status="pending", updated_at="1735862400", evidence_lines_json="broken [", run_id="lost", created_at=None),
        finding(13, key, "Open", 3, score=0.5, verification_status="CONFIRMED", updated_at=None, run_id="r1", created_at="2025-01-01T00:00:00.2+00:00", summary="One two three four five six seven eight nine ten"),
        finding(20, "1::VaultOpenEx::sign_flip", "Run", 1, score=float("nan")),
        finding(21, "2::VaultOpenEx::sign_flip", "Run", 2, score=0.7),
        finding(22, "1::VaultOpenEx::sign_flip", "Run", None, score=0.7),
        finding(23, "1::VaultOpenEx::sign_flip", "Run", 1, score=1.5),
        finding(24, None, None, None, module=None, score=0.7),
    ]
    c = [("A.dll", 1, "Run", "Net Work", 5, day(1)), ("a.dll", 1, "Run", "network", 9, day(3)), ("a.dll", 1, "Run", "network", 9, day(3)), ("a.dll", 2, "Run", "NETWORK ", 3, day(2)), ("a.dll", 3, "Open", "network", 99, day(2)), ("b.exe", 1, "Open", "other", 1, day(1)), ("b.exe", 2, "x", None, 1, day(1))]
    docs = [(1, "Eins. Zwei.", "de", " Notes", 1, None), (2, None, None, None, None, None), (3, "", "en", "notes", 0, "m"), (4, "words and words " * 3000, "en", "OTHER", 9, "m"), (5, "abc", None, "none", 3, "m")]
    return folder(
        spark, tmp_path_factory.mktemp("t"), request.param, findings=f, classification_results=c, module_functions=FUNCTION_ROWS, taxonomy=TERMS, status_trust=TRUST, documents=docs,
        scan_runs=[("r1", "a.dll", "ok", day(1)), ("R2", "a.dll", "ok", day(2)), (None, None, None, None)], keep_targets=[("network", 0.5), ("empty", 0.5)], mix_targets=[("Notes", 0.9, 2), ("other", 0.1, 1), ("gone", 0.01, 5)],
    )


def rows(spark, d, name):
    return sorted(map(tuple, QUERIES[name](spark, d).collect()))


def test_p1(spark, d):
    assert rows(spark, d, "p1_found") == [("network", 9)]
    r = QUERIES["p1_report"](spark, d).first()
    assert (r["kept"], r["scored"]) == (1, 2)


def test_p3(spark, d):
    assert rows(spark, d, "p3_found") == [(10, 11, 10, 11), (20, 0, 20, 0)]
    r = {x["first_id"]: x for x in QUERIES["p3_survivors"](spark, d).collect()}
    assert r[10]["n"] == 4 and r[10]["current_status"] == "LIKELY" and r[20]["current_status"] is None


def test_p4(spark, d):
    # 22 is of function 1 (interest 9), 21 of function 2 (interest 3)
    assert rows(spark, d, "p4_found") == [(10, 2), (11, 3), (12, 1), (21, 2), (22, 1)]


def test_p6(spark, d):
    assert rows(spark, d, "p6_found") == [(10, 13), (11, 13)]


def test_p6_near(spark, d):
    assert [tuple(r) for r in QUERIES["p6_near"](spark, d).collect()] == [(10, 13, 0.9, 1)]


def test_p6_near_leaves_out_no_link(spark, tmp_path):
    """Every stored summary that covers one comes out, not the best alone; copies of a summary have theirs."""
    def f(id, summary, created):
        return finding(id, run_id="r1", created_at=f"2025-01-0{created}T00:00:00Z", summary=summary)

    made = [f(1, "one two three four five six seven eight nine ten", 1), f(2, "one two three four five six seven eight nine eleven", 2), f(3, "one two three four five six seven eight nine twelve", 3), f(4, "one two three four five six seven eight nine ten", 4), f(5, "no link", 5), f(6, "No link", 6)]
    d = folder(spark, tmp_path, findings=made, scan_runs=[("r1", "a.dll", "ok", day(1))])
    assert rows(spark, d, "p6_near") == [(2, 1, 0.9, 1), (3, 1, 0.9, 2), (3, 2, 0.9, 2), (4, 1, 1.0, 3), (4, 2, 0.9, 3), (4, 3, 0.9, 3), (6, 5, 1.0, 1)]


def test_p7_p8_p9(spark, d):
    ids = dict(rows(spark, d, "p7_ids"))
    assert ids[2] == [] and ids[3] == [] and len(ids) == 5 and len(ids[4]) > 5000
    assert rows(spark, d, "p8_found") == [("Notes",), ("gone",)]
    assert rows(spark, d, "p9_found")[:2] == [(1, 0, 5), (1, 6, 11)]
    assert QUERIES["p8_mix"](spark, d).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, tmp_path, name):
    assert QUERIES[name](spark, folder(spark, tmp_path)).count() == 0
