"""SQL that checks the queries on training data, for another engine."""

from __future__ import annotations

_MODULE = r"nullif(lower(regexp_extract(trim(module), '([^/\\]*)$', 1)), '')"
_NAME = "nullif(regexp_replace(lower(trim(function_name)), '^(__imp_|_imp_|j_|cs:)', ''), '')"


def _slug(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"


def _micros(c: str) -> str:
    return f"""CASE WHEN regexp_full_match(trim({c}), '-?\\d+(\\.\\d+)?') THEN CAST(CAST(trim({c}) AS DECIMAL(20,6)) * 1000000 AS BIGINT)
 WHEN regexp_matches(trim({c}), '([zZ]|[+-]\\d{{2}}:\\d{{2}})$') THEN epoch_us(TRY_CAST(trim({c}) AS TIMESTAMPTZ))
 ELSE epoch_us(TRY_CAST(trim({c}) AS TIMESTAMP)) END"""


_LATEST = f"""latest AS (SELECT module, function_id, r.c AS category, r.i AS interest FROM (
 SELECT {_MODULE} AS module, function_id, max_by({{'c': primary_category, 'i': CASE WHEN interest_score BETWEEN 0 AND 10 THEN interest_score ELSE -1 END}}, classified_at) AS r
 FROM classification_results GROUP BY 1, 2))"""

_CUTOFFS = f"""
WITH {_LATEST},
scored AS (SELECT k.primary_category, k.keep_fraction, interest FROM latest JOIN keep_targets k ON {_slug('k.primary_category')} = {_slug('category')} WHERE interest >= 0),
sizes AS (SELECT primary_category, keep_fraction, count(*) AS n FROM scored GROUP BY ALL),
tried AS (SELECT s.primary_category, s.keep_fraction, s.n, c.c, (SELECT count(*) FROM scored x WHERE x.primary_category = s.primary_category AND x.interest >= c.c) AS kept FROM sizes s, (SELECT unnest(range(0, 11)) AS c) c)
SELECT primary_category, CAST(max(c) AS INTEGER) AS cutoff, max_by(kept, c) AS kept, max(n) AS scored, max(keep_fraction) AS keep_fraction FROM tried WHERE kept >= keep_fraction * n GROUP BY 1
"""

_TERM = "regexp_replace(regexp_replace(lower(trim({c})), '^(__imp_|_imp_|j_|cs:)', ''), '[^a-z0-9]+', '', 'g')"

_STATED = f"""
names AS (SELECT lower(module_id) AS m, lower(function_name) AS nk, min(function_id) AS only_id FROM module_functions GROUP BY 1, 2 HAVING count(*) = 1),
parts AS (SELECT *, {_MODULE} AS m, string_split(regexp_replace(trim(dedup_key), '\\s*::\\s*', '::', 'g'), '::') AS a, coalesce(trim(dedup_key), '') <> '' AS keyed FROM findings),
told AS (SELECT *, CASE WHEN keyed THEN {_TERM.format(c='a[-2]')} ELSE {_TERM.format(c='sink')} END AS ss, CASE WHEN keyed THEN {_TERM.format(c='a[-1]')} ELSE {_TERM.format(c='source_category')} END AS cs,
 CASE WHEN keyed THEN array_to_string(a[(CASE WHEN len(a) >= 4 AND regexp_matches(lower(a[1]), '\\.[a-z0-9]{{2,4}}$') THEN 2 ELSE 1 END):-3], '::') END AS token FROM parts),
numbered AS (SELECT *, CASE WHEN NOT keyed THEN function_id WHEN regexp_full_match(lower(token), '0x[0-9a-f]+') THEN CAST(lower(token) AS BIGINT) WHEN regexp_full_match(token, '\\d+') THEN CAST(token AS BIGINT) END AS fid FROM told),
near_sinks AS (SELECT ss, arg_min(term, (damerau_levenshtein(ss, {_slug('term')}), term)) AS t FROM (SELECT DISTINCT ss FROM told WHERE ss <> ''), taxonomy WHERE kind = 'sink' GROUP BY 1),
near_cats AS (SELECT cs, arg_min(term, (damerau_levenshtein(cs, {_slug('term')}), term)) AS t FROM (SELECT DISTINCT cs FROM told WHERE cs <> ''), taxonomy WHERE kind = 'source_category' GROUP BY 1),
stated AS (SELECT f.* EXCLUDE (function_id, sink, module), f.m AS module, coalesce(f.fid, n.only_id) AS function_id, s.t AS sink, c.t AS category
 FROM numbered f JOIN near_sinks s USING (ss) JOIN near_cats c USING (cs) LEFT JOIN names n ON f.keyed AND f.fid IS NULL AND n.m = f.m AND n.nk = lower(f.token)
 WHERE f.m IS NOT NULL AND coalesce(f.fid, n.only_id) IS NOT NULL)
"""

_J = "evidence_lines_json"
_LINES = f"""(CASE WHEN NOT json_valid({_J}) OR {_J} IS NULL THEN 0
 WHEN json_type({_J}) = 'ARRAY' THEN len(list_filter(json_extract({_J}, '$[*]'), lambda x: json_type(x) = 'VARCHAR' AND trim(json_extract_string(x, '$')) <> ''))
 WHEN json_type({_J}) = 'VARCHAR' AND json_valid(json_extract_string({_J}, '$')) THEN len(list_filter(json_extract(json_extract_string({_J}, '$'), '$[*]'), lambda x: json_type(x) = 'VARCHAR' AND trim(json_extract_string(x, '$')) <> ''))
 WHEN json_type({_J}) = 'VARCHAR' AND trim(json_extract_string({_J}, '$')) <> '' THEN 1 ELSE 0 END)"""

_SURVIVORS = f"""
WITH {_STATED},
ranked AS (SELECT id, module, function_id, sink, category, coalesce({_micros('updated_at')}, -9223372036854775807) AS moment, coalesce(trust, 0) AS trust, {_LINES} AS lines
 FROM stated LEFT JOIN status_trust t ON {_slug('t.status')} = {_slug('verification_status')})
SELECT min(id) AS first_id, CASE WHEN max(trust) > 0 THEN arg_max(id, (trust, moment, -id)) ELSE 0 END AS status_id, arg_max(id, (moment, -id)) AS recent_id, CASE WHEN max(lines) > 0 THEN arg_max(id, (lines, moment, -id)) ELSE 0 END AS evidence_id
FROM ranked GROUP BY module, function_id, sink, category HAVING count(*) > 1
"""

_TOP = f"""
WITH {_LATEST},
names AS (SELECT lower(module_id) AS module, lower(function_name) AS nk, CASE WHEN count(*) = 1 THEN min(function_id) END AS only_id FROM module_functions GROUP BY 1, 2),
parts AS (SELECT id, score, {_MODULE} AS module, {_NAME} AS nk, function_id, regexp_extract(lower(dedup_key), '(?:^|::)\\s*(0x[0-9a-f]+|\\d+)\\s*::', 1) AS k FROM findings),
rows_ AS (SELECT p.id, p.score, p.module, p.nk, coalesce(p.function_id, CASE WHEN k <> '' THEN CAST(k AS BIGINT) END, n.only_id) AS function_id FROM parts p JOIN names n USING (module, nk) WHERE score >= 0 AND score <= 1)
SELECT id, CAST(place AS INTEGER) AS place FROM (
 SELECT id, row_number() OVER (PARTITION BY r.module, nk ORDER BY score DESC, coalesce(interest, -1) DESC, id) AS place FROM rows_ r LEFT JOIN latest l ON l.module = r.module AND l.function_id = r.function_id)
WHERE place <= 3
"""

_REPEATS = f"""
WITH {_STATED},
ordered AS (SELECT id, module, function_id, sink, category, first_value(id) OVER (PARTITION BY module, function_id, sink, category ORDER BY started_at, {_micros('created_at')}, id) AS first_id
 FROM stated JOIN (SELECT lower(trim(run_id)) AS run, min(started_at) AS started_at FROM scan_runs GROUP BY 1) r ON r.run = lower(trim(run_id)))
SELECT least(id, first_id) AS id_a, greatest(id, first_id) AS id_b FROM ordered WHERE id <> first_id
"""

ORACLES = {
    "p1_found": f"SELECT primary_category, cutoff FROM ({_CUTOFFS})",
    "p1_report": _CUTOFFS,
    "p3_found": _SURVIVORS,
    "p4_found": _TOP,
    "p6_found": _REPEATS,
}
