from __future__ import annotations

import datetime

from factloom.llm.queries import QUERIES
from tests.fixture_tables import FUNCTION_ROWS, TERMS, finding, folder


def test_runs_of_one_instant_are_ordered_by_creation(spark, tmp_path):
    """The run's name decides nothing, whether the start is equal or null."""
    t = datetime.datetime(2025, 1, 1)
    runs = [("a", "a.dll", "ok", t), ("b", "a.dll", "ok", t), ("c", "a.dll", "ok", None), ("d", "a.dll", "ok", None)]

    def f(id, key, run, created):
        return finding(id, key, run_id=run, created_at=created)

    made = [
        f(1, "3::VaultOpen::type_mixup", "a", "2025-01-03 00:00:00"), f(2, "3::VaultOpen::type_mixup", "b", "2025-01-02 00:00:00"), f(3, "3::VaultOpen::type_mixup", "a", "2025-01-04 00:00:00"),
        f(4, "3::VaultOpen::sign_flip", "c", "2025-01-03 00:00:00"), f(5, "3::VaultOpen::sign_flip", "d", "2025-01-02 00:00:00"), f(6, "3::VaultOpen::sign_flip", "a", "2025-01-01 00:00:00"),
    ]
    d = folder(spark, tmp_path, findings=made, module_functions=FUNCTION_ROWS, taxonomy=TERMS, scan_runs=runs)
    assert sorted(map(tuple, QUERIES["p6_found"](spark, d).collect())) == [(1, 2), (2, 3), (4, 5), (5, 6)]
