from __future__ import annotations

import random

import pyarrow as pa
import pytest

from factloom.llm.segments import END, History, Segment, Store, covered, covered_words, earliest, near_repeats, nearest, probes_of, repeats, windows_of, words_of


def test_segments_stay_few():
    h = History()
    for i in range(1000):
        h.add(Segment.of([(f"r{i}", i)]))
    assert len(h.segments) <= 10 and sum(len(s.refs) for s in h.segments) == 1000
    assert all(len(h.segments[i].refs) > len(h.segments[i + 1].refs) for i in range(len(h.segments) - 1))


def test_matches_against_brute_force():
    r = random.Random(5)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(200)]
    h = History()
    for k in range(0, 200, 7):
        h.add(Segment.of([(t + END, i) for i, t in enumerate(texts) if k <= i < k + 7]))

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    for q in ("a", "ab", "abba", "bbbbbbbb", "x", ""):
        for least in (1, 3, len(q) + 1):
            want = sorted((i, common(q + END, t + END)) for i, t in enumerate(texts) if common(q + END, t + END) >= least)
            assert sorted(h.matches(q + END, least)) == want


def test_covered():
    assert covered([(5, 9), (0, 3), (2, 4), (6, 7)]) == 8 and covered([]) == 0


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(6)
    data = [("hot", r.randrange(5), r.randrange(9), i) for i in range(300)] + [(f"t{r.randrange(80)}", r.randrange(5), None if i % 9 == 0 else r.randrange(9), 1000 + i) for i in range(300)]
    data += [(None, 1, 1, 5000), (None, 1, 1, 5001), ("", 1, 1, 5002), ("", 0, 1, 5003), ("long " * 5000, 2, 2, 5004), ("late", None, 1, 5005), ("late", 0, 1, 5006)]
    return data, "t string, batch int, at int, id bigint"


def brute(data):
    first = {}
    low = lambda v: -1 if v is None else v
    for t, b, a, i in sorted((x for x in data if x[0] is not None), key=lambda x: (low(x[1]), low(x[2]), x[3])):
        first.setdefault(t, i)
    return sorted((first[t], i) for t, _, _, i in data if t is not None and first[t] != i)


def test_pairs(spark, rows):
    data, schema = rows
    df = spark.createDataFrame(data, schema)
    assert sorted(map(tuple, repeats(df, "t", ["batch", "at"], "id").collect())) == brute(data)
    many = {r["t"]: r["n"] for r in earliest(df, "t", ["batch", "at"], "id").collect()}
    assert many["hot"] == 300 and many[""] == 2 and min(many.values()) > 1
    assert repeats(df.limit(0), "t", ["batch", "at"], "id").count() == 0


def test_batches_one_by_one(spark, rows, tmp_path):
    """Each call gets its batch's rows and the store, nothing else; segments already there stay or are merged."""
    data, schema = rows
    store, got, read = Store(spark, str(tmp_path / "store")), [], []
    for b in (None, 0, 1, 2, 3, 4):
        batch = spark.createDataFrame([x for x in data if x[1] == b], schema)
        got += map(tuple, repeats(batch, "t", ["batch", "at"], "id", store).collect())
        read.append(len(store.generations("whole")))
    assert sorted(got) == brute(data)
    assert max(read) <= 4
    stored = [r["suffix"] for t in store.tables("whole") for r in t.collect()]
    assert sorted(stored) == sorted({x[0] for x in data if x[0] is not None})
    assert Store(spark, str(tmp_path / "store")).generations("whole") == store.generations("whole")


def test_words_of_scripts_without_blanks():
    assert words_of("Ab_c, 3.5 函数读") == ["ab", "c", "3", "5", "函", "数", "读"]
    assert len(windows_of(list("abcdef"))) == 2 and windows_of([]) == []


def test_probes_suffice():
    """Whatever windows a record shares so that they cover the share, one of them is a probe (unless it is in this text only)."""
    r = random.Random(8)
    for _ in range(300):
        n = r.randrange(5, 30)
        w = [r.randrange(2, 9) for _ in range(n - 4)]
        p = set(probes_of(w, n))
        for _ in range(20):
            s = {i for i in range(n - 4) if r.random() < 0.8}
            if covered([(i, i + 5) for i in s]) >= 0.8 * n:
                assert s & p


def near_pairs(data, share=0.8):
    """Brute force: earlier different texts that cover the share of a text's words by windows of five."""
    low = lambda v: -1 if v is None else v
    first = {}
    for t, b, a, i in sorted((x for x in data if x[0] and x[0].strip()), key=lambda x: (low(x[1]), low(x[2]), x[3])):
        first.setdefault(t, i)
    seen, out = [], set()
    for t, i in first.items():
        w = words_of(t)
        h = windows_of(w) if len(w) >= 5 else []
        for j, g in seen:
            if h and covered([(k, k + 5) for k, x in enumerate(h) if x in g]) >= share * len(w) - 1e-9:
                out.add((i, j))
        seen.append((i, set(h)))
    return out


@pytest.fixture(scope="module")
def planted():
    """Texts with a common opening, and near copies with a word changed, dropped or added, in later batches."""
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    opening = "the parser copies the length field before the lock is taken".split()
    data, wanted = [], set()
    for i in range(150):
        body = (opening if i % 2 else []) + [r.choice(vocabulary) for _ in range(r.randrange(25, 60))]
        data.append((" ".join(body), i % 4, i, i))
        if i % 3 == 0:
            near = list(body)
            k = r.randrange(len(near))
            near[k : k + 1] = [[], ["changed"], [near[k], "added"]][i % 9 // 3]
            data.append((" ".join(near), 4 + i % 3, i, 1000 + i))
            wanted.add((1000 + i, i))
    data += [(data[0][0], 5, 1, 3000), ("函数读取会话记录并且忽略旧句柄与共享段", 1, 1, 4000), ("函数读取会话记录并且忽略旧句柄与共享区", 2, 1, 4001), ("too short", 1, 1, 5000), ("too short a", 2, 1, 5001), (None, 1, 1, 6000), (" ", 1, 1, 6001)]
    return data, wanted | {(4001, 4000)}


def test_covered_words():
    r = random.Random(3)
    pairs = [([r.randrange(6) for _ in range(r.randrange(0, 12))], [r.randrange(6) for _ in range(r.randrange(0, 5))]) for _ in range(400)]
    want = [covered([(i, i + 5) for i, x in enumerate(q) if x in t]) for q, t in pairs]
    arrays = [pa.array([p[k] for p in pairs], pa.list_(pa.int64())) for k in (0, 1)]
    assert list(covered_words(*arrays)) == want
    assert list(covered_words(arrays[0][100:200], arrays[1][100:200])) == want[100:200]
    assert list(covered_words(arrays[0][:0], arrays[1][:0])) == [] and list(covered_words(pa.array([[]], pa.list_(pa.int64())), arrays[1][:1])) == [0]


def test_nearest(spark):
    p = spark.createDataFrame([(1, 9, 0.8), (1, 7, 0.9), (1, 8, 0.9), (2, 1, 1.0)], "id bigint, stored_id bigint, coverage double")
    assert sorted(map(tuple, nearest(p).collect())) == [(1, 7, 0.9, 3), (2, 1, 1.0, 1)]


def test_near_copies(spark, planted, tmp_path):
    data, wanted = planted
    schema = "t string, batch int, at int, id bigint"
    want = near_pairs(data)
    assert wanted <= want
    got = near_repeats(spark.createDataFrame(data, schema), "t", ["batch", "at"], "id").collect()
    assert {(r["id"], r["stored_id"]) for r in got} == want and len(got) == len(want)
    assert all(0.8 <= r["coverage"] <= 1 for r in got)
    store, parts = Store(spark, str(tmp_path / "near")), set()
    for b in ([0, 1], [2, 3], [4, 5, 6]):
        part = near_repeats(spark.createDataFrame([x for x in data if x[1] in b], schema), "t", ["batch", "at"], "id", store)
        parts |= {(r["id"], r["stored_id"]) for r in part.collect()}
    assert parts == want
    assert near_repeats(spark.createDataFrame([], schema), "t", ["batch", "at"], "id").count() == 0


def near_rows(data, share=0.8):
    """Brute force: each row with each different text that an earlier row has, its own among them."""
    low = lambda v: -1 if v is None else v
    first, out = {}, {}
    for t, b, a, i in sorted((x for x in data if x[0] and x[0].strip()), key=lambda x: (low(x[1]), low(x[2]), x[3])):
        w = words_of(t)
        h = windows_of(w)
        for s, (j, g) in first.items():
            c = 1.0 if s == t else min(len(w), covered([(k, k + 5) for k, x in enumerate(h) if x in g])) / len(w) if w else 0
            if c >= share - 1e-9:
                out[i, j] = round(c, 6)
        first.setdefault(t, (i, set(h)))
    return out


def test_each_row_has_all_its_near_copies(spark, planted, tmp_path):
    """Copies have links of their own, also to texts stored after their first row; short texts are one window; batches give what the whole gives."""
    data = [*planted[0], *[(t, 2 + i % 5, 50, 8000 + i) for i, (t, _, _, _) in enumerate(planted[0][:60])]]
    data += [("Too short!", 0, 9, 9000), ("???", 0, 0, 9001), ("???", 5, 0, 9002), ("hot text of many rows here", 0, 0, 9100), ("hot text of many rows there", 3, 0, 9101)] + [("hot text of many rows here", i % 7, i, 9200 + i) for i in range(200)]
    schema = "t string, batch int, at int, id bigint"
    want = near_rows(data)
    assert {(9101, 9100), (9206, 9101), (9002, 9001), (5000, 9000)} <= set(want) and (9203, 9101) in want and (9202, 9101) not in want
    links = {i: sum(x == i for x, _ in want) for i, _ in want}

    def told(found):
        rows = found.collect()
        assert len({(r["id"], r["stored_id"]) for r in rows}) == len(rows)
        return {(r["id"], r["stored_id"]): (r["coverage"], r["links"]) for r in rows}

    asked = {k: (c, links[k[0]]) for k, c in want.items()}
    assert told(near_repeats(spark.createDataFrame(data, schema), "t", ["batch", "at"], "id", each=True)) == asked
    store, parts = Store(spark, str(tmp_path / "each")), {}
    for b in ([0, 1], [2, 3], [4, 5, 6]):
        parts |= told(near_repeats(spark.createDataFrame([x for x in data if x[1] in b], schema), "t", ["batch", "at"], "id", store, each=True))
    assert parts == asked
    assert near_repeats(spark.createDataFrame([], schema), "t", ["batch", "at"], "id", each=True).count() == 0
