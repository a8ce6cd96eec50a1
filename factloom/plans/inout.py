"""Queries that write and read again: indexes and profiles as JSON, runs' steps, stores of findings, buckets, stubs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.columns import computed, table, unit_number
from factloom.operators import relational as R
from factloom.operators import store
from factloom.session import own_folder, written
from factloom.sources import readers, sinks
from factloom.streaming import windows

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _texts(df: DataFrame, path: str) -> None:
    """Write rows (module, value) as text files, a folder per module, a line per row."""
    df.write.partitionBy("module").text(path)


@query(
    """SELECT 'module=' || lower(module_id) AS module, function_name AS name, CAST(min(function_id) AS BIGINT) AS function_id, coalesce(min(decompiled_code), '') <> '' AS has_decompiled, count(*) AS n FROM (SELECT * FROM module_functions WHERE function_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(module_id), function_name ORDER BY function_id) = 1) GROUP BY 1, 2"""
)
def json_index(spark, d):
    """Function indexes as JSON objects, a file per task and module, read as indexes again."""
    f = table(spark, d, "module_functions").where("function_name IS NOT NULL").groupBy(F.lower("module_id").alias("module"), "function_name").agg(F.min(F.struct("function_id", "decompiled_code")).alias("f"))
    one = F.to_json(F.create_map("function_name", F.struct(F.col("f.function_id").alias("function_id"), (F.coalesce("f.decompiled_code", F.lit("")) != "").alias("has_decompiled"), F.array(F.lit("a.c")).alias("files"))))
    path = own_folder(spark, "index")
    _texts(f.select("module", one.alias("value")), path)
    return readers.function_index(spark, path, lines=True).groupBy("module", "name").agg(F.min("function_id").alias("function_id"), F.bool_or("has_decompiled").alias("has_decompiled"), F.count(F.lit(1)).alias("n"))


@query("""SELECT 'module=' || lower(module_id) AS module, count(*) AS functions FROM module_functions GROUP BY 1""")
def module_profiles(spark, d):
    """Profiles of modules as JSON texts, read as variants again."""
    p = table(spark, d, "module_functions").groupBy(F.lower("module_id").alias("module")).agg(F.count(F.lit(1)).alias("n"))
    path = own_folder(spark, "profile")
    _texts(p.select("module", F.to_json(F.struct(F.struct(F.col("n").alias("function_count")).alias("scale"))).alias("value")), path)
    return readers.profiles(spark, path).select("module", F.try_variant_get("profile", F.lit("$.scale.function_count"), "bigint").alias("functions"))


@query("""SELECT 'module=' || lower(file_extension) AS module, count(*) > 0 AS found FROM analyzed_files WHERE file_extension IS NOT NULL GROUP BY 1""")
def discovered_files(spark, d):
    """Files under a folder, listed without reading them, with statistics per module."""
    f = table(spark, d, "analyzed_files").where("file_extension IS NOT NULL").select(F.lower("file_extension").alias("module"), F.col("file_name").alias("value"))
    path = own_folder(spark, "files")
    _texts(f, path)
    found = readers.discovered(spark, path, "*.txt").withColumn("module", F.regexp_extract("path", r"([^/]+)/[^/]*$", 1))
    return readers.file_stats(found).select("module", ((F.col("n") > 0) & (F.col("bytes") > 0)).alias("found"))


@query("SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE id END AS payload FROM findings")
def tolerant_json(spark, d):
    """JSON between other output, in an envelope or not, and broken texts."""
    i = F.col("id")
    text = F.when(i % 3 == 0, F.concat(F.lit('warming up\n{"status": "ok", "data": {"id": '), i, F.lit("}}\ndone"))).when(i % 3 == 1, F.concat(F.lit('{"id": '), i, F.lit("}"))).otherwise(F.concat(F.lit('{"id": '), i))
    f = table(spark, d, "findings").select("id", readers.unwrapped(readers.json_inside(text)).alias("v"))
    return f.select("id", F.try_variant_get("v", F.lit("$.id"), "bigint").alias("payload"))


@query("""WITH a AS (SELECT lower(module_id) AS module, 'json' AS via FROM module_functions WHERE length(module_id) % 2 = 0), b AS (SELECT lower(module_id) AS module, 'table' AS via FROM module_functions) SELECT module, via, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE module NOT IN (SELECT module FROM a)) GROUP BY 1, 2""")
def first_available(spark, d):
    """Rows of the first source, and of the second for modules that the first lacks."""
    f = table(spark, d, "module_functions").select(F.lower("module_id").alias("module"))
    out = readers.first_available(f.where(F.length("module") % 2 == 0).withColumn("via", F.lit("json")), f.withColumn("via", F.lit("table")), "module")
    return out.groupBy("module", "via").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT substr(md5_hash, 1, 8) || '-' || substr(md5_hash, 9, 4) || '-' || substr(md5_hash, 13, 4) || '-' || substr(md5_hash, 17, 4) || '-' || substr(md5_hash, 21, 12) AS interface_id, file_name FROM analyzed_files WHERE md5_hash IS NOT NULL) SELECT interface_id, CAST(0 AS INTEGER) AS position, 'Open' AS procedure, 'string name,byte[] data' AS parameters FROM s UNION ALL SELECT interface_id, 1, 'Close', '' FROM s""")
def stub_procedures(spark, d):
    """Client stubs of every binary, written as source texts and read for their procedures."""
    h = lambda a, n: F.substring("md5_hash", a, n)
    uuid_ = F.concat_ws("-", h(1, 8), h(9, 4), h(13, 4), h(17, 4), h(21, 12))
    text = F.concat(F.lit("// interface "), uuid_, F.lit("\n    public int Open(string name, byte[] data)\n    public void Close()"))
    path = own_folder(spark, "stubs")
    _texts(table(spark, d, "analyzed_files").where("md5_hash IS NOT NULL").select(F.col("md5_hash").alias("module"), text.alias("value")), path)
    return readers.stub_procedures(spark, path).select("interface_id", F.col("position").cast("int").alias("position"), "procedure", F.array_join("parameters", ",").alias("parameters"))


# ---------------------------------------------------------------- stores and sinks

_STORE = """k AS (SELECT trim(dedup_key) AS k, CASE WHEN score >= 0 AND score <= 1 THEN score END AS score, verification_status AS st, exploitability_score AS ex, id FROM findings WHERE coalesce(trim(dedup_key), '') <> ''),
o AS (SELECT k, min(id) AS id, max(score) AS score FROM k GROUP BY 1), c AS (SELECT k, max(id) AS last FROM k GROUP BY 1 HAVING count(*) > 1)"""


def _keyed(spark, d) -> tuple[DataFrame, DataFrame]:
    """A store with a row per key, and changes for the keys of two rows or more."""
    f = computed(table(spark, d, "findings"), ["id"], k=F.trim("dedup_key"), score=unit_number(F.col("score"))).where("k <> ''")
    g = f.groupBy("k").agg(F.min("id").alias("id"), F.max("score").alias("score"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    return g.select("k", "id", "score", F.lit("NEW").alias("verification_status")), g.where("n > 1")


@query(f"WITH {_STORE} SELECT o.k, o.id, CASE WHEN c.k IS NULL THEN o.score ELSE greatest(o.score, 0.5) END AS score, CASE WHEN c.k IS NULL THEN 'NEW' ELSE 'CONFIRMED' END AS verification_status FROM o LEFT JOIN c USING (k)")
def store_verification(spark, d):
    old, changes = _keyed(spark, d)
    return store.verified(old, changes.select("k", F.lit("CONFIRMED").alias("verification_status"), F.lit(0.5).alias("score")), "k")


@query(f"WITH {_STORE} SELECT o.k, o.id, coalesce(CASE WHEN c.last % 2 = 0 THEN 0.25 END, o.score) AS score, 'NEW' AS verification_status FROM o LEFT JOIN c USING (k)")
def store_overwrite(spark, d):
    old, changes = _keyed(spark, d)
    return store.overwritten(old, changes.select("k", F.when(F.col("last") % 2 == 0, 0.25).alias("score")), "k", ["score"])


@query("""WITH s AS (SELECT lower(trim(run_id)) AS run, 'step' || (length(coalesce(module, '')) % 3) AS step, status, epoch_us(started_at) AS updated, step_count FROM scan_runs) SELECT run, step, max_by({'s': status}, (coalesce(updated, -1), step_count IS NOT NULL, step_count)).s AS status FROM s GROUP BY 1, 2""")
def current_steps(spark, d):
    """The last record of each step of each run."""
    r = table(spark, d, "scan_runs")
    s = r.select(F.lower(F.trim("run_id")).alias("run"), F.concat(F.lit("step"), F.length(F.coalesce("module", F.lit(""))) % 3).alias("step"), "status", F.unix_micros("started_at").alias("updated"), F.col("step_count").alias("seq"))
    return sinks.current_steps(s).select("run", "step", "status")


@query("""SELECT id, CASE WHEN extra_json IS NULL OR NOT json_valid(extra_json) THEN NULL WHEN json_type(extra_json) = 'ARRAY' THEN CAST(json_array_length(extra_json) AS INTEGER) WHEN json_type(extra_json) = 'OBJECT' THEN CAST(len(json_keys(extra_json)) AS INTEGER) END AS size FROM findings""")
def payload_sizes(spark, d):
    """The size of nested payloads: an object's keys, an array's length."""
    return sinks.payload_summary(table(spark, d, "findings").select("id", "extra_json"), "extra_json").select("id", "size")


@query("""SELECT status, count(*) AS n, min(length(run_id)) AS shortest FROM scan_runs GROUP BY 1""")
def json_emission(spark, d):
    """Rows as JSON texts, written at once, and read by a schema again."""
    r = table(spark, d, "scan_runs").select("run_id", "status")
    path = own_folder(spark, "emitted")
    sinks.write_table(sinks.as_json(r, "value"), path, "text")
    back = spark.read.schema(r.schema).json(path)
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("run_id")).alias("shortest").cast("bigint"))


@query("SELECT module, count(*) AS n FROM findings GROUP BY 1")
def partitioned_table(spark, d):
    """A table written by columns of few values and read with pruning, as a whole again."""
    f = written(table(spark, d, "findings").select("id", "module", "run_id"), "findings")
    return f.groupBy("module").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT run_id, status, step_count FROM scan_runs")
def json_envelopes(spark, d):
    """Rows in JSON envelopes, written as texts and taken out of them again."""
    r = table(spark, d, "scan_runs").select("run_id", "status", "step_count")
    path = own_folder(spark, "envelopes")
    sinks.write_table(sinks.enveloped(r, "run", "value"), path, "text")
    v = spark.read.text(path).select(readers.unwrapped(readers.json_inside(F.col("value"))).alias("v"))
    return v.select(*[F.try_variant_get("v", F.lit(f"$.{c}"), t).alias(c) for c, t in (("run_id", "string"), ("status", "string"), ("step_count", "int"))])


@query("SELECT n_name AS nation, count(c_custkey) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def opened_tables(spark, d):
    """A checked statement over tables that were opened to be read only."""
    t = readers.open_tables(spark, d, ["nation", "customer"])
    return R.safe_select(spark, "SELECT n_name AS nation, count(c_custkey) AS customers FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey GROUP BY 1", **t)


# ---------------------------------------------------------------- streams, over the same tables


def _streamed(spark, d, name: str, columns: list[str]) -> DataFrame:
    """A table's file as a stream."""
    schema = table(spark, d, name).schema
    src = spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/{name}.parquet*")
    return src.select(*[F.col(c).cast("timestamp").alias(c) if schema[c].dataType.typeName() == "timestamp_ntz" else c for c in columns])


@query("SELECT user_id, max(value) AS value FROM events GROUP BY 1")
def streamed_upsert(spark, d):
    """Events upserted from a stream, batch by batch, and the store as it is then."""
    path = own_folder(spark, "upserted")
    src = _streamed(spark, d, "events", ["event_id", "user_id", "value"])
    sink = windows.upsert_sink(path, "user_id", "value", "event_id", [])
    q = src.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return windows.read_upserted(spark, path).select("user_id", "value")


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_distinct(spark, d):
    """Rows of a stream without repeats of their keys inside a watermark as long as the events."""
    path = own_folder(spark, "distinct")
    src = windows.distinct_within(_streamed(spark, d, "events", ["ts", "user_id", "event_type"]), "ts", ["user_id", "event_type"], "3650 days")
    q = src.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(src.schema).parquet(path).select("user_id", "event_type")


@query("SELECT user_id, max(value) AS value FROM events GROUP BY 1")
def streamed_rising(spark, d):
    """Scores that rose above all before, by state per key; of the rows that came out the last of each key."""
    path = own_folder(spark, "rising")
    out = windows.rising_scores(_streamed(spark, d, "events", ["user_id", "value"]), "user_id", "value")
    q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(out.schema).parquet(path).groupBy("user_id").agg(F.max("value").alias("value"))
