"""Sinks: whole tables that appear at once, JSON texts, and run manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.store import latest


def write_table(df: DataFrame, path: str, kind: str = "parquet", partitions: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write a table; readers see it once its commit is done."""
    w = df.write.format(kind).mode(mode)
    (w.partitionBy(*partitions) if partitions else w).save(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON text; null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def enveloped(df: DataFrame, kind: str, name: str = "json") -> DataFrame:
    """Each row as a JSON text in an envelope: {"status": "ok", "kind": ..., "data": {...}}; readers.unwrapped() takes it off."""
    return df.select(F.to_json(F.struct(F.lit("ok").alias("status"), F.lit(kind).alias("kind"), F.struct(*df.columns).alias("data"))).alias(name))


def bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> None:
    """A table whose rows are hashed by keys into buckets, so that joins on them need no shuffle."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(name)


def current_steps(steps: DataFrame) -> DataFrame:
    """The last record of each (run, step) of an append-only table (run, step, status, updated, seq)."""
    return latest(steps, ["run", "step"], "updated", "seq")


def payload_summary(df: DataFrame, column: str) -> DataFrame:
    """(keys, size) of a JSON column: an object's first keys, or an array's length."""
    size = F.coalesce(F.json_array_length(column), F.size(F.json_object_keys(column)))
    return df.withColumn("keys", F.slice(F.json_object_keys(column), 1, 10)).withColumn("size", size)
