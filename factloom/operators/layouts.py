"""Layouts of structures from accesses in code and assembly, class members, and generated headers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalar import mangled_parts

# Sizes of types in code, of pointers in assembly, and the registers of the first arguments.
TYPE_SIZES = {"char": 1, "BYTE": 1, "_BYTE": 1, "WORD": 2, "_WORD": 2, "short": 2, "int": 4, "DWORD": 4, "_DWORD": 4, "float": 4, "QWORD": 8, "_QWORD": 8, "double": 8, "void *": 8, "__int64": 8}
POINTER_SIZES = {"byte": 1, "word": 2, "dword": 4, "qword": 8, "xmmword": 16}
ARGUMENT_REGISTERS = {"rcx": 1, "rdx": 2, "r8": 3, "r9": 4}
STACK_REGISTERS = ("rsp", "rbp", "esp", "ebp")

_CODE = re.compile(r"[A-Za-z_]\w*|0[xX][0-9A-Fa-f]+|\d+|[=!<>]=|[^\s\w]")
_ASM = re.compile(r"^\s*(\w+)\s+(.*)$")
_MEMORY = re.compile(r"(?:(byte|word|dword|qword|xmmword)\s+ptr\s+)?\[\s*(\w+)\s*(?:\+\s*([0-9A-Fa-f]+)h?)?\s*\]", re.I)
_MOVE = re.compile(r"^\s*mov\s+(\w+)\s*,\s*(\w+)\s*$", re.I)

SCHEMA = "module string, function_id bigint, base string, byte_offset int, size int, access string, source string"


def code_accesses(code: str | None) -> Iterator[tuple[str, int, int, str]]:
    """(base, offset, size, read or write) of accesses through pointers in decompiled code: *(type *)(base + n), or *(base + n) of pointer size; those with a type come first."""
    untyped = []
    t = _CODE.findall(code or "") + [""] * 4

    def sum_at(i: int) -> tuple[str, int, int] | None:
        """(base, offset, place after it) of a sum in brackets that begins at token i."""
        base, plus, number, close = t[i : i + 4]
        if base.isidentifier() and plus == "+" and number[:1].isdigit() and close == ")":
            return base, int(number, 0) if number[:2].lower() == "0x" else int(number), i + 4
        return None

    for i in range(len(t) - 4):
        if t[i] != "*" or t[i + 1] != "(":
            continue
        j = i + 2
        while t[j].isidentifier():
            j += 1
        words, stars = t[i + 2 : j], j
        while t[stars] == "*":
            stars += 1
        if words and stars > j and t[stars] == ")" and t[stars + 1] == "(":  # a cast
            of = " ".join(w for w in words if w != "unsigned") + " *" * (stars - j - 1)
            found, size = sum_at(stars + 2), TYPE_SIZES.get(of, 8)
        else:
            found, size = sum_at(i + 2), None
        if found:
            base, offset, after = found
            access = (base, offset, size or 8, "write" if t[after] == "=" else "read")
            if size:
                yield access
            else:
                untyped.append(access)
    yield from untyped


def assembly_accesses(code: str | None) -> Iterator[tuple[str, int, int, str]]:
    """The same in assembly: bases are argN for argument registers and their copies; stack accesses are left out."""
    if not code:
        return
    alias = {r: f"arg{n}" for r, n in ARGUMENT_REGISTERS.items()}
    for line in code.splitlines():
        if m := _MOVE.match(line):
            to, of = m.group(1).lower(), m.group(2).lower()
            if of in alias:
                alias[to] = alias[of]
            else:
                alias.pop(to, None)
            continue
        op = _ASM.match(line)
        if not op:
            continue
        for m in _MEMORY.finditer(op.group(2)):
            base = m.group(2).lower()
            if base in STACK_REGISTERS or base not in alias:
                continue
            first = op.group(2).find("[") < op.group(2).find(",") if "," in op.group(2) else False
            yield alias[base], int(m.group(3) or "0", 16), POINTER_SIZES.get((m.group(1) or "qword").lower(), 8), "write" if op.group(1).lower() == "mov" and first else "read"
        target = op.group(2).split(",")[0].strip().lower()
        if "[" not in target:
            alias.pop(target, None)


def accesses(functions: DataFrame) -> DataFrame:
    """All field accesses of functions (module, function_id, decompiled_code, assembly_code), one row each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for p in parts:
            rows = []
            for m, f, c, a in zip(p["module"], p["function_id"], p["decompiled_code"], p["assembly_code"]):
                rows += [(m, f, *x, "code") for x in code_accesses(c)] + [(m, f, *x, "assembly") for x in assembly_accesses(a)]
            yield pd.DataFrame(rows, columns=cols)

    return functions.select("module", "function_id", "decompiled_code", "assembly_code").mapInPandas(run, SCHEMA)


def fields(a: DataFrame, keys=("module", "base")) -> DataFrame:
    """(keys, byte_offset, size, kinds, sources, verified): one row per field; a size seen in assembly counts first."""
    v = F.col("source") == "assembly"
    return a.groupBy(*keys, "byte_offset").agg(
        F.max_by("size", F.struct(v, "size")).alias("size"),
        F.array_join(F.array_sort(F.collect_set("access")), ",").alias("kinds"),
        F.count_distinct("function_id").alias("sources"),
        F.bool_or(v).alias("verified"),
    )


def confidence(fields_: DataFrame) -> DataFrame:
    return fields_.withColumn("confidence", F.when(F.col("verified") & (F.col("sources") > 1), "high").when(F.col("verified") | (F.col("sources") > 1), "medium").otherwise("low"))


def class_members(functions: DataFrame) -> DataFrame:
    """(class, constructors, destructors, methods, tables) of functions (mangled_name), by full class name."""
    m = functions.select(mangled_parts(F.col("mangled_name")).alias("p")).where("p.class_name IS NOT NULL")
    full = F.concat_ws("::", "p.namespaces", "p.class_name")
    of = lambda r: F.count_if(F.col("p.role") == r)
    return m.groupBy(full.alias("class")).agg(of("constructor").alias("constructors"), of("destructor").alias("destructors"), of("method").alias("methods"), of("vftable").alias("tables"))


def headers(fields_: DataFrame, key: str) -> DataFrame:
    """(key, header): a structure's text with its fields in order of offset."""
    line = F.concat(F.lit("  uint8_t field_"), F.hex("byte_offset"), F.lit("["), F.col("size"), F.lit("];  // 0x"), F.hex("byte_offset"))
    g = fields_.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("byte_offset", line.alias("line")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return g.select(key, F.concat(F.lit("struct "), F.col(key), F.lit(" {\n"), body, F.lit("\n};")).alias("header"))
