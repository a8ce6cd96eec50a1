from __future__ import annotations

import time

import json

import pytest
from pyspark.sql import functions as F

from factloom.session import cut, shared_dir, written
from factloom.sources import readers, sinks
from factloom.streaming import windows


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, "b,\"c\"")], "id int, t string")
    options = {"header": "true"} if kind == "csv" else {}
    df.write.format(kind).options(**options).save(str(tmp_path / kind))
    got = readers.read(spark, str(tmp_path / kind), kind, df.schema, **({"escape": "\\"} if kind == "csv" else {}))
    assert sorted(map(tuple, got.select("id", "t").collect())) == [(1, "a"), (2, 'b,"c"')]
    with pytest.raises(ValueError):
        readers.read(spark, "x", "nope")


def test_function_index(spark, tmp_path):
    for m, t in (("app", json.dumps({"A": {"files": ["a.c"], "library": None, "function_id": 1, "has_decompiled": True}, "B": {"file": "b.c", "library": "WIL"}})), ("bad", "{")):
        (tmp_path / m).mkdir()
        (tmp_path / m / "function_index.json").write_text(t)
    i = readers.function_index(spark, f"{tmp_path}/*/function_index.json")
    got = {r["name"]: (r["module"], r["files"], r["library"], r["has_decompiled"]) for r in i.collect()}
    assert got == {"A": ("app", ["a.c"], None, True), "B": ("app", ["b.c"], "WIL", False)}
    assert readers.by_library(i, app_only=True).count() == 1 and readers.by_library(i, lib_only=True).count() == 1 and readers.by_library(i, "wil").first()["name"] == "B" and readers.by_library(i).count() == 2
    p = readers.profiles(spark, f"{tmp_path}/app/*.json")
    assert p.select(F.try_variant_get("profile", F.lit("$.A.function_id"), "int")).first()[0] == 1
    assert {r["module"] for r in readers.discovered(spark, str(tmp_path), "*.json").collect()} == {"function_index.json"}


def test_json_in_output(spark):
    df = spark.createDataFrame([('log line\n{"status": "ok", "data": {"a": 1}}\nbye',), ("[1, 2]",), ("nothing",), (None,)], "t string")
    v = df.select(readers.json_inside(F.col("t")).alias("v"))
    assert [r[0] for r in v.select(F.try_variant_get(readers.unwrapped(F.col("v")), F.lit("$.a"), "int")).collect()] == [1, None, None, None]
    assert [r[0] for r in v.select(F.col("v").isNotNull()).collect()] == [True, True, False, False]


def test_stubs(spark, tmp_path):
    head = "// 12345678-1234-1234-1234-1234567890AB\nclass C {\n"
    (tmp_path / "a.cs").write_text(head + "  public int Old(int a) {}\n}")
    (tmp_path / "b.cs").write_text(head + "  public int Open(string n, out Ptr<A, B> h)\n  public void Close()\n}")
    (tmp_path / "c.cs").write_text("class D { public int X() }")
    got = [tuple(r) for r in readers.stub_procedures(spark, f"{tmp_path}/*.cs").orderBy("position").collect()]
    assert got == [("12345678-1234-1234-1234-1234567890ab", 0, "Open", ["string n", "out Ptr<A, B> h"]), ("12345678-1234-1234-1234-1234567890ab", 1, "Close", [])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None)], "id int, t string, x string")
    sinks.write_table(df, str(tmp_path / "t"), partitions=["id"])
    sinks.write_table(df, str(tmp_path / "t"), partitions=["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert sinks.as_json(df).first()[0] == '{"id":1,"t":"a"}'
    steps = spark.createDataFrame([("r", "s", "running", 1, 1), ("r", "s", "ok", 2, 2), ("r", "u", "ok", None, 3)], "run string, step string, status string, updated int, seq int")
    assert sorted((r["step"], r["status"]) for r in sinks.current_steps(steps).collect()) == [("s", "ok"), ("u", "ok")]
    p = spark.createDataFrame([('{"a": 1, "b": 2}',), ("[1, 2, 3]",), ("x",)], "j string")
    assert [(r["keys"], r["size"]) for r in sinks.payload_summary(p, "j").collect()] == [(["a", "b"], 2), (None, 3), (None, None)]


def test_shared_folder(spark):
    df = spark.range(10)
    assert cut(df).count() == 10 and written(df, "t").count() == 10 and shared_dir(spark)


def test_first_available(spark):
    a, b = spark.createDataFrame([(1, "json")], "m int, s string"), spark.createDataFrame([(1, "db"), (2, "db")], "m int, s string")
    assert sorted(map(tuple, readers.first_available(a, b, "m").collect())) == [(1, "json"), (2, "db")]


def stream(spark, df, path, files=3):
    df.repartition(files).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{name}")).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i, f"2025-01-01 00:{i % 60:02}:00", f"u{i % 3}", float(i * 7 % 50)) for i in range(90)]
    return spark.createDataFrame(rows, "id int, at string, user string, value double").select("id", F.col("at").cast("timestamp").alias("ts"), "user", "value")


def test_streaming_windows(spark, events, tmp_path):
    s = stream(spark, events, tmp_path / "in")
    got = run(windows.tumbling(s, "ts", "10 minutes", ["user"], None), "tumbling", "complete", tmp_path)
    want = windows.tumbling(events, "ts", "10 minutes", ["user"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert windows.tumbling(events, "ts", "10 minutes", slide="5 minutes").count() == 13
    assert windows.sessions(events, "ts", "2 minutes", ["user"]).count() >= 3


def test_streaming_scores_rise(spark, events, tmp_path):
    got = run(windows.rising_scores(stream(spark, events, tmp_path / "in"), "user", "value"), "rising", "append", tmp_path)
    best = {r["user"]: r["m"] for r in events.groupBy("user").agg(F.max("value").alias("m")).collect()}
    assert {r["user"]: r["m"] for r in got.groupBy("user").agg(F.max("value").alias("m")).collect()} == best


def test_streaming_distinct(spark, events, tmp_path):
    got = run(windows.distinct_within(stream(spark, events, tmp_path / "in"), "ts", ["user"], "1 day"), "distinct", "append", tmp_path)
    assert sorted(r["user"] for r in got.collect()) == ["u0", "u1", "u2"] and windows.distinct_within(events, "ts", ["user"], "1 day").count() == 3


def test_streaming_upsert(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i % 4}", float(i), f"s{i}", i) for i in range(40)], "k string, score double, status string, seq int")
    path = str(tmp_path / "store")
    q = stream(spark, df.coalesce(1), tmp_path / "in").writeStream.foreachBatch(windows.upsert_sink(path, "k", "score", "seq", ["status"])).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["k"]: r["score"] for r in windows.read_upserted(spark, path).collect()} == {f"k{i}": 36.0 + i for i in range(4)}


def test_progress_of_a_stream(spark, events, tmp_path):
    from factloom.streaming.progress import watch

    told = []
    p = watch(spark, lambda name, batch, rows, total: told.append((name, batch, rows, total)))
    try:
        q = stream(spark, events, tmp_path / "in").writeStream.format("noop").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        for _ in range(50):
            if any(t[0] == "watched" and t[3] == events.count() for t in told):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(p)
    assert any(t[0] == "watched" and t[3] == events.count() for t in told)
