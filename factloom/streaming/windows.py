"""Windows over time, the same for batch and streaming tables, and a streaming upsert."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factloom.operators import store


def _late(df: DataFrame, ts: str, lateness: str | None) -> DataFrame:
    return df.withWatermark(ts, lateness) if df.isStreaming and lateness else df


def tumbling(df: DataFrame, ts: str, width: str, keys: Sequence[str] = (), lateness: str | None = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, keys, n) per window; with slide, windows overlap."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _late(df, ts, lateness).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, ts: str, gap: str, keys: Sequence[str], lateness: str | None = "10 minutes") -> DataFrame:
    """(start, end, keys, n) of runs of rows without a gap."""
    g = _late(df, ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def distinct_within(df: DataFrame, ts: str, keys: Sequence[str], lateness: str) -> DataFrame:
    """Rows without repeats of the keys inside the watermark (all of them on a batch table)."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def upsert_sink(path: str, key: str, score: str, order: str, touched: Sequence[str], keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts each batch into a versioned parquet table under a path.

    Each version is written beside the last one before it counts (its _SUCCESS file), and a batch that
    runs again writes the same version again, so a restart neither loses nor doubles rows.  The last `keep`
    versions before a new one stay, for its readers and for a batch that runs again.
    """

    def versions(spark) -> list[int]:
        conf = spark._jsc.hadoopConfiguration()
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            return []
        done = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(x.getName().split("=")[1]) for x in done)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = store.folded(batch, key, score, order, touched)
        before = [v for v in versions(spark) if v < number]
        out = store.upsert(spark.read.schema(new.schema).parquet(f"{path}/version={before[-1]}"), new, key, score, touched) if before else new
        out.write.mode("overwrite").parquet(f"{path}/version={number}")
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for v in before[:-keep]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}"), True)

    return run


def read_upserted(spark, path: str) -> DataFrame:
    """The latest complete version."""
    conf = spark._jsc.hadoopConfiguration()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    v = max(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(f"{path}/version={v}")


#: Keeps state on disk beside memory; states of transformWithStateInPandas need it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Rising(StatefulProcessor):
    """Gives a key's score whenever it is above all before; the state is one number per key."""

    def __init__(self, key: str, score: str):
        self.key, self.score = key, score

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - the interface's names
        top = max((float(p[self.score].max()) for p in rows), default=float("-inf"))
        if not self.best.exists() or top > self.best.get()[0]:
            self.best.update((top,))
            yield pd.DataFrame({self.key: [key[0]], self.score: [top]})

    def close(self) -> None:
        pass


def rising_scores(df: DataFrame, key: str, score: str) -> DataFrame:
    """(key, score) of a stream whenever a key's score rises above all before; null and NaN scores never do."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    ok = df.select(key, F.col(score).cast("double").alias(score)).where(F.col(score).isNotNull() & ~F.isnan(score))
    return ok.groupBy(key).transformWithStateInPandas(_Rising(key, score), f"{key} {dict(df.dtypes)[key]}, {score} double", "Append", "None")
