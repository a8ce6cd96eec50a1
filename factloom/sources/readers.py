"""Sources: tables of several formats, JSON indexes and profiles, module folders, and tolerant JSON texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.cleaning import module_key

ENTRY = "struct<files:array<string>,file:string,library:string,function_id:bigint,has_decompiled:boolean,has_assembly:boolean>"
INDEX = f"map<string,{ENTRY}>"

FORMATS = {"parquet": {}, "orc": {}, "json": {}, "csv": {"header": "true"}, "text": {}}


def read(spark: SparkSession, path: str | Sequence[str], kind: str = "parquet", schema=None, **options: str) -> DataFrame:
    """A table by path and format; give a schema for CSV and JSON, so that they aren't read twice."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    r = spark.read.format(kind).options(**{**FORMATS[kind], **options})
    return (r.schema(schema) if schema else r).load(path if isinstance(path, str) else list(path))


def open_tables(spark: SparkSession, folder: str, names: Sequence[str], kind: str = "parquet") -> dict[str, DataFrame]:
    """Tables of a folder by name, to be read only: nothing is registered in the session, so no statement can change them.

    Missing tables are refused at once, before any of them is scanned.
    """
    return {n: read(spark, f"{folder.rstrip('/')}/{n}.{kind}", kind) for n in names}


def jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database table for a one-time import, read in ranges of a numeric column; needs the driver's jar."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column:
        r = r.option("partitionColumn", partition_column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return r.load()


def function_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(module, name, files, library, function_id, has_decompiled, has_assembly) of JSON indexes, one object per file.

    The module is the file's folder.  A lone 'file' counts as a list of one.  Broken files give no rows.
    lines: each line is an object of its own, so that an index of any size is read in pieces.
    """
    t = spark.read.text(path, wholetext=not lines).select("value", F.col("_metadata.file_path").alias("p"))
    folder = F.regexp_extract("p", r"([^/]+)/[^/]*$", 1)
    e = t.select(folder.alias("module"), F.explode(F.from_json("value", INDEX)).alias("name", "e"))
    files = F.coalesce("e.files", F.when(F.col("e.file").isNotNull(), F.array("e.file")), F.array().cast("array<string>"))
    flag = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(False)).alias(c)
    return e.select("module", "name", files.alias("files"), F.col("e.library").alias("library"), F.col("e.function_id").alias("function_id"), flag("has_decompiled"), flag("has_assembly"))


def by_library(index: DataFrame, library: str | None = None, app_only: bool = False, lib_only: bool = False) -> DataFrame:
    """Entries of one library, else of none (app_only), else of any (lib_only), else all."""
    if library is not None:
        return index.where(F.lower("library") == library.lower())
    if app_only:
        return index.where(F.col("library").isNull())
    return index.where(F.col("library").isNotNull()) if lib_only else index


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """(module, profile) with the profile as a variant; fields by paths, such as $.scale.function_count."""
    t = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    return t.select(F.regexp_extract("p", r"([^/]+)/[^/]*$", 1).alias("module"), F.try_parse_json("value").alias("profile")).where("profile IS NOT NULL")


def discovered(spark: SparkSession, root: str, pattern: str = "*.db") -> DataFrame:
    """(module, path, bytes, modified) of files under a folder, without reading them."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return f.select(module_key(F.col("path")).alias("module"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def json_inside(text: Column) -> Column:
    """The JSON object or array that a text holds between other output, as a variant; null if none parses."""
    span = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.when(span != "", span)))


def unwrapped(v: Column, keys: Sequence[str] = ("data", "results", "items")) -> Column:
    """The payload of an envelope with a status: its first present key, else the value itself."""
    inner = F.coalesce(*[F.try_variant_get(v, F.lit(f"$.{k}"), "variant") for k in keys])
    return F.when(F.try_variant_get(v, F.lit("$.status"), "string").isNotNull(), F.coalesce(inner, v)).otherwise(v)


def first_available(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of the primary source, and of the other one for keys that it lacks."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def stub_procedures(spark: SparkSession, path: str) -> DataFrame:
    """(interface_id, position, procedure, parameters) of client stub sources.

    The interface id is taken from the first 30 lines (files without one are left out); positions count
    the public methods.  Of several files of an interface the last by path counts.
    """
    t = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    head = F.array_join(F.slice(F.split("value", "\n"), 1, 30), "\n")
    uuid = F.lower(F.regexp_extract(head, r"([0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12})", 1))
    t = t.select("p", "value", uuid.alias("interface_id")).where("interface_id <> ''")
    t = t.groupBy("interface_id").agg(F.max_by("value", "p").alias("value"))
    method = r"(?m)^\s*public\s+(?!class|static|override)[\w<>\[\].,? ]+?\s+(\w+\s*\([^)]*\))"
    m = t.select("interface_id", F.posexplode(F.regexp_extract_all("value", F.lit(method), F.lit(1))).alias("position", "m"))
    inner = F.trim(F.regexp_extract("m", r"\((.*)\)", 1))
    params = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r",\s*(?![^<]*>)"))
    return m.select("interface_id", "position", F.regexp_extract("m", r"^(\w+)", 1).alias("procedure"), params.alias("parameters"))


def file_stats(files: DataFrame) -> DataFrame:
    """(module, n, bytes, oldest, newest) of discovered files."""
    return files.groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("modified").alias("oldest"), F.max("modified").alias("newest"))
