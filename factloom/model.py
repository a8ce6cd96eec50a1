"""Schemas of the fact tables' JSON columns, and loaders that parse them once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XREFS = "array<struct<function_name:string,name:string,function_id:bigint,module_name:string,function_type:int,xref_type:string,extraction_type:string,_truncated:boolean>>"
GLOBALS = "array<struct<address:string,name:string,access_type:string,_truncated:boolean>>"
LOOPS = "struct<loop_count:int,loops:array<struct<nesting_level:int,cyclomatic_complexity:int,complexity:int,is_infinite:boolean>>,analysis_available:boolean>"
FRAME = "struct<local_vars_size:int,args_size:int,saved_regs_size:int,has_canary:boolean,frame_pointer_present:boolean,exception_handler:string>"
VTABLES = "array<struct<reconstructed_classes:array<string>,source_ea:string,class_name:string,class:string>>"
IMPORTS = "array<struct<module_name:string,name:string,raw_module_name:string,is_api_set:boolean,functions:array<struct<function_name:string,name:string,address:string,ordinal:bigint,is_delay_loaded:boolean>>>>"
EXPORTS = "array<struct<function_name:string,name:string,ordinal:bigint,address:string,mangled_name:string,is_forwarded:boolean,forwarded_to:string>>"
STRINGS = "array<string>"


def json_or_empty(c: Column | str, schema: str) -> Column:
    """A JSON list parsed by its schema; null, blank, malformed and 'null' texts give an empty list."""
    return F.coalesce(F.from_json(c, schema), F.from_json(F.lit("[]"), schema))


def untruncated(items: Column) -> Column:
    """A list without the marker that a cut list ends in."""
    return F.filter(items, lambda x: F.coalesce(~x["_truncated"], F.lit(True)))


def has_value(c: Column | str, lists: bool = True) -> Column:
    """The textual test for a JSON column: not null, not '', not 'null...' and (for lists) not '[]...'."""
    c = F.col(c) if isinstance(c, str) else c
    ok = c.isNotNull() & (c != "") & ~c.startswith("null")
    return ok & ~c.startswith("[]") if lists else ok


def parsed_functions(functions: DataFrame) -> DataFrame:
    """module_functions with module in lower case and its JSON columns parsed; the plain columns stay."""
    f = functions.withColumn("module", F.lower("module_id"))
    return f.select(
        "module",
        "function_id",
        "function_name",
        "function_signature",
        "mangled_name",
        "decompiled_code",
        "assembly_code",
        untruncated(json_or_empty("simple_outbound_xrefs", XREFS)).alias("outbound"),
        untruncated(json_or_empty("simple_inbound_xrefs", XREFS)).alias("inbound"),
        untruncated(json_or_empty("global_var_accesses", GLOBALS)).alias("globals"),
        json_or_empty("dangerous_api_calls", STRINGS).alias("dangerous"),
        json_or_empty("string_literals", STRINGS).alias("strings"),
        F.from_json("loop_analysis", LOOPS).alias("loops"),
        F.from_json("stack_frame", FRAME).alias("frame"),
        json_or_empty("vtable_contexts", VTABLES).alias("vtables"),
    )


def xref_name(x: Column) -> Column:
    """An edge's target name under either of its keys."""
    return F.coalesce(x["function_name"], x["name"])
