"""Queries on findings beside brute force, on every JSON shape."""

from __future__ import annotations

import hashlib
import json

from factloom.plans.findings import QUERIES
from tests.fixture_tables import finding, folder


def signature(*nodes):
    return hashlib.sha256("|".join(sorted(nodes)).encode()).hexdigest()[:16]


#: Path texts and their nodes; None where there is no path.
PATHS = [
    ('["a", "b"]', ["a", "b"]),
    (' [ "b", "a" ]', ["a", "b"]),
    ('[{"function": "b", "sites": []}, {"function": "a"}]', ["a", "b"]),
    ('[null, {"function": "a", "sites": [{"line": 1}]}, null]', ["a"]),
    ('["nullify", "{x}"]', ["nullify", "{x}"]),
    ('["a", {"_truncated": true, "original_count": 9}]', ["a"]),
    (json.dumps(json.dumps(["c", "d"])), ["c", "d"]),
    (json.dumps(json.dumps([{"function": "c"}, {"function": "e"}])), ["c", "e"]),
    ('"lone"', ["lone"]),
    ('{"function": "solo", "sites": [{"line": 3}]}', ["solo"]),
    ("[]", []),
    ("[null]", []),
    ('["a", 7, true]', ["a", "7", "true"]),
    ("null", None),
    ('["a", "b', None),
    (json.dumps('["a", "b'), None),
    ("", None),
    (None, None),
]


def top_paths(rows):
    """(key, signature, id, score) by brute force."""
    out = []
    for key in {k for k, *_ in rows}:
        seen = {}
        for i, score, nodes in sorted(((i, s, n) for k, i, s, n in rows if k == key), key=lambda r: (-r[1], r[0])):
            seen.setdefault(signature(*nodes), (i, score))
        out += [(key, sig, *x) for sig, x in list(seen.items())[:3]]
    return sorted(out)


def test_paths_of_every_shape(spark, tmp_path):
    made, rows = [], []
    for j, (text, nodes) in enumerate(PATHS):
        for key, i, score in [(f"k{j}", j, 0.5), ("all", 100 + j, (j * 7 % 18) / 20), (f"odd{j % 3}", 200 + j, 0.5)]:
            made.append(finding(i, f" {key} ", path_json=text, score=score))
            if nodes is not None:
                rows.append((key, i, score, nodes))
    made += [finding(300, "k0", path_json='["z"]', score=1.5), finding(301, "k0", path_json='["z"]', score=None), finding(302, " ", path_json='["z"]', score=0.5)]
    got = QUERIES["dedup_top3_paths"](spark, folder(spark, tmp_path, True, findings=made)).select("dedup_key", "signature", "id", "score").collect()
    assert sorted(map(tuple, got)) == top_paths(rows)


def test_steps_of_no_known_shape(spark, tmp_path):
    deep = "[" * 3000 + "1" + "]" * 3000
    texts = ['[{"a": 1, "b": [2]}]', '[{"b": [2], "a": 1}]', '[{"a": 1, "b": [3]}]', f"[{deep}]", '["\\ud800"]']
    d = folder(spark, tmp_path, findings=[finding(i, "k" if i < 3 else f"k{i}", path_json=t, score=0.5) for i, t in enumerate(texts)])
    assert sorted(r["id"] for r in QUERIES["dedup_top3_paths"](spark, d).collect()) == [0, 2, 3, 4]


def test_guards_of_every_shape(spark, tmp_path):
    g = lambda d: {"guard_type": "canary", "bypass_difficulty": d}
    j = json.dumps
    guards = [
        (j([g("hard"), g("medium")]), 0.4),
        ("\n [" + j(g("hard")) + "]", 0.6),
        (j(g("hard")), 0.6),
        (j(j([g("medium")])), 0.8),
        (j(j(g("easy"))), 0.9),
        (j([j(g("hard")), "text", None]), 0.6),
        (j([g(None), g("odd"), {"guard_type": "x"}, {"_truncated": True}]), 0.8),
        (j([{"checks": [{"bypass_difficulty": "hard"}]}]), 1.0),
        (j([g("hard")] * 3), 0.0),
        (j("lone"), 1.0),
        ("[]", 1.0),
        ("null", None),
        ('[{"bypass_difficulty": "hard"', None),
        (j('[{"bypass_difficulty": "hard"'), None),
        ("", None),
        (None, None),
    ]
    d = folder(spark, tmp_path, True, findings=[finding(i, guards_json=t) for i, (t, _) in enumerate(guards)])
    got = {r["id"]: r["bypass"] for r in QUERIES["guard_bypass"](spark, d).collect()}
    assert got == {i: x for i, (_, x) in enumerate(guards) if x is not None}
