from __future__ import annotations

import difflib

import pytest
from pyspark.sql import functions as F

from factloom.operators import search as S

SUB = [("Token", "token", 1.0), ("TokenBorrow", "token", 0.85), ("my_token", "token", 0.75), ("getToken", "token", 0.75), ("xtokens", "token", 0.6), ("GETTOKEN", "token", 0.6), ("", "token", None), ("other", "token", None), ("a.b", "a.b", 1.0)]


@pytest.mark.parametrize("text,query,want", SUB)
def test_substring(spark, text, query, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S.substring_quality(F.col("t"), query)).first()[0] == want


def test_regex(spark):
    df = spark.createDataFrame([("ParseHeader",), ("xParse",), ("none",), (None,)], "t string")
    got = [r[0] for r in df.select(S.regex_quality(F.col("t"), "parse[a-z]*")).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(0.6 + 0.4 * 5 / 6) and got[2:] == [None, None]
    assert df.select(S.regex_quality(F.col("t"), "(")).first()[0] is None


def test_fuzzy(spark):
    texts = ["ParseHeader", "parseheaderx", "XParseHeader", "PareHeader", "zzz", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(S.fuzzy_quality("ParseHeader")(F.col("t"))).collect()]
    r = difflib.SequenceMatcher(None, "pareheader", "parseheader", autojunk=False).ratio()
    assert got[:3] == [1.0, 0.85, 0.6] and got[3] == pytest.approx(0.3 + 0.25 * r) and got[4:] == [None, None, None]


def test_literals():
    assert S.literal_of("^ParseHeader$") == "ParseHeader" and S.literal_of(r"foo\.bar") == "foo.bar"
    assert S.literal_of("a|b") is None and S.literal_of("ab") is None
    for p, t in ((r"Parse\d+Head", "xParse12Head"), ("Load.*Node", "LoadXNode"), ("abcd?e", "abce"), ("abc+", "abccc")):
        lit = S.literal_of(p)
        assert lit is None or lit in t


def test_search_counts_each_function_once(spark):
    t = "module string, id bigint, name string, dim string, pos int, text string, has_code boolean, has_danger boolean"
    rows = [("m", 1, "OpenToken", "name", 0, "OpenToken", True, False), ("m", 1, "OpenToken", "string", 2, "token", True, False), ("m", 1, "OpenToken", "string", 2, "a token", True, False), ("m", 2, "Other", "string", 2, "tokens", False, True)]
    got = {r["id"]: (r["score"], r["dim"], r["dims"]) for r in S.search(spark.createDataFrame(rows, t), S.substring_quality(F.col("text"), "token")).collect()}
    assert got == {1: (0.85, "string", 2), 2: (0.625, "string", 1)}
    assert S.search(spark.createDataFrame(rows, t), S.substring_quality(F.col("text"), "token"), ["name"]).count() == 1
    assert S.search(spark.createDataFrame(rows, t).limit(0), S.substring_quality(F.col("text"), "token")).count() == 0


def test_snippet(spark):
    df = spark.createDataFrame([("a" * 50 + "KEY" + "b" * 50,), ("KEY",), ("no",)], "t string")
    got = [r[0] for r in df.select(S.snippet(F.col("t"), "key")).collect()]
    assert got == ["..." + "a" * 20 + "KEY" + "b" * 40 + "...", "KEY", None]


def test_more_texts_than_are_tried_one_by_one(spark, monkeypatch):
    from factloom.operators import search as S

    names = spark.createDataFrame([("m", 1, "OnDispatch"), ("m", 2, "ParseHeader"), ("m", 3, "ParseFooter"), ("k", 4, None), ("k", 5, "")], "module string, id bigint, name string")
    wanted = spark.createDataFrame([("dispatch",), ("parse",), ("foot",), ("r",), ("er",), ("nothing",), ("",), (None,)], "wanted string")
    few = sorted(map(str, S.resolve(names, wanted.where("wanted <> ''")).collect()))
    monkeypatch.setattr(S, "MOST_WANTED", 2)
    assert sorted(map(str, S.resolve(names, wanted.where("wanted <> ''")).collect())) == few
    got = sorted((r["name"], r["wanted"]) for r in S.held(names.withColumn("low", F.lower("name")), "low", wanted, "wanted").collect())
    assert got == sorted((n, w) for n in ("OnDispatch", "ParseHeader", "ParseFooter") for w in ("dispatch", "parse", "foot", "r", "er", "nothing") if w in n.lower())
