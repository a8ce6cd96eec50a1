"""Session construction and the shared folder that all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew handling)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own in a local session, else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-"))
        drop_at_exit(spark, sc._jsc.sc().getCheckpointDir().get())
    return named or sc._jsc.sc().getCheckpointDir().get()


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder of this application's own once it ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for this application only."""
    path = f"{shared_dir(spark).rstrip('/')}/factloom/{name}-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in the shared folder, so that later work survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def placed(df: DataFrame, *keys: str) -> DataFrame:
    """cut() of a table hashed by keys into spark.sql.shuffle.partitions parts, so that later joins and groups on them don't shuffle it.

    Without keys the table's own partitioning is kept.  Adaptive execution is off while the table is planned, as it forgets the
    partitioning of what it runs; so keys have to be even.
    """
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys) if keys else df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame as a table of the shared folder and read it again."""
    spark = df.sparkSession
    path = own_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def setting(spark: SparkSession, path: str, default: str) -> str:
    """A setting by dotted path: FACTLOOM_A_B in the environment, else factloom.a.b of the session, else the default."""
    return os.environ.get("FACTLOOM_" + path.upper().replace(".", "_")) or spark.conf.get(f"factloom.{path}", default)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of the shared folder; None if there is none."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it there, so that readers see the old or the new one."""
    fs, p = _path(spark, path)
    _, beside = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"can't write {path}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="factloom-src-"), "factloom_src.zip")  # on the driver, which serves it
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "factloom")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
