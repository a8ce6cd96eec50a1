"""Scalar functions on names, code, signatures and scores, as Columns or pandas UDFs."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.cleaning import _PREFIX_PATTERN

# Words that look like calls in code.
KEYWORDS = ("if", "for", "while", "switch", "return", "sizeof")
# Lower bounds of severity bands.
BANDS = (("CRITICAL", 0.75), ("HIGH", 0.55), ("MEDIUM", 0.35))
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def strip_import(c: Column) -> Column:
    """One import mark taken off the front."""
    return F.regexp_replace(c, _PREFIX_PATTERN, "")


def class_of(c: Column) -> Column:
    """The name after 'class' or 'struct' in a declaration."""
    return F.regexp_extract(c, r"(?:class|struct)\s+([\w:]+)", 1)


def name_kind(c: Column) -> Column:
    return F.when(F.lower(c).startswith("sub_"), "unnamed").when(c.contains("::"), "method").when(c.startswith("~"), "destructor").otherwise("function")


def parameter_count(signature: Column) -> Column:
    """Parameters of a signature, by its outermost parentheses; 0 for none."""
    inner = F.regexp_extract(signature, r"\((.*)\)", 1)
    flat = inner  # commas of nested types and function pointers don't count: brackets are emptied from the inside, four deep
    for _ in range(4):
        flat = F.regexp_replace(flat, r"<[^<>()]*>|\([^<>()]*\)", "")
    return F.when(inner == "", 0).otherwise(F.size(F.split(flat, ","))).cast("bigint")


def calls_in(code: Column) -> Column:
    """Distinct names called in a function's body."""
    body = F.substring(code, F.locate("{", code), F.length(code))
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(r"([A-Za-z_~][\w:~]*)\s*\("), F.lit(1)))
    return F.filter(found, lambda x: ~x.isin(*KEYWORDS))


def inferred_parameters(code: Column) -> Column:
    """The greatest N of names aN in code, 0 without any."""
    found = F.regexp_extract_all(code, F.lit(r"\ba(\d{1,3})\b"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda x: x.cast("int"))), F.lit(0))


def severity(score: Column, bands: Sequence[tuple[str, float]] = BANDS, lowest: str = "LOW") -> Column:
    out = F.when(score >= bands[0][1], bands[0][0])
    for name, least in bands[1:]:
        out = out.when(score >= least, name)
    return F.when(score.isNotNull() & ~F.isnan(score), out.otherwise(lowest))


def severity_rank(c: Column) -> Column:
    """1 to 4 for the named levels, 0 for anything else."""
    u = F.upper(F.trim(c))
    out = F.when(u == SEVERITIES[0], 1)
    for i, s in enumerate(SEVERITIES[1:], 2):
        out = out.when(u == s, i)
    return out.otherwise(0)


def hop_decay(hops: Column) -> Column:
    return 1 / F.sqrt(F.greatest(hops, F.lit(1)))


def aligned(offset: Column, size: Column) -> Column:
    """The next multiple of size from offset on."""
    return F.when(size <= 1, offset).otherwise(F.ceil(offset / size) * size).cast("bigint")


def bypass(guards: Column) -> Column:
    """1 less the difficulties' weights, from 0 to 1, to 3 decimals; 1 without guards.  guards: array of difficulty texts."""
    weight = lambda x: F.when(x == "hard", 0.4).when(x == "medium", 0.2).when(x == "easy", 0.1).otherwise(0.1)
    return F.round(F.greatest(F.lit(0.0), F.aggregate(guards, F.lit(1.0), lambda a, x: a - weight(x))), 3)


def truncated(c: Column, most: int) -> Column:
    """At most so many characters, with an ellipsis where cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def safe_name(c: Column, fallback: str = "item", most: int = 80) -> Column:
    """Letters, digits, dot, hyphen and underscore only."""
    s = F.substring(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""), 1, most)
    return F.when(F.coalesce(s, F.lit("")) == "", fallback).otherwise(s)


def longest_prefix(names: DataFrame, column: str, prefixes: Sequence[tuple[str, str]]) -> Column:
    """The class of the longest listed prefix of a name, null without one."""
    for p, _ in prefixes:
        if not p:
            raise ValueError("an empty prefix")
    out = None
    for p, k in sorted(prefixes, key=lambda x: (-len(x[0]), x[0])):
        hit = F.col(column).startswith(p)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out if out is not None else F.lit(None).cast("string")


@F.pandas_udf(T.ArrayType(T.StringType()))
def balanced_arguments(calls: pd.Series) -> pd.Series:
    """The arguments of the first call in a text, split at commas outside brackets and quotes; null if it doesn't close."""

    def one(t: str | None):
        if not t or "(" not in t:
            return None
        depth, quote, start, out = 0, "", t.index("(") + 1, []
        for i in range(start - 1, len(t)):
            ch = t[i]
            if quote:
                quote = "" if ch == quote and t[i - 1] != "\\" else quote
            elif ch in "\"'":
                quote = ch
            elif ch in "([{":
                depth += 1
            elif ch in ")]}":
                depth -= 1
                if not depth:
                    last = t[start:i].strip()
                    return [*out, last] if last or out else []
            elif ch == "," and depth == 1:
                out.append(t[start:i].strip())
                start = i + 1
        return None

    return calls.map(one, na_action="ignore")


_MANGLED = T.StructType(
    [T.StructField("class_name", T.StringType()), T.StructField("namespaces", T.ArrayType(T.StringType())), T.StructField("method", T.StringType()), T.StructField("role", T.StringType())]
)


@F.pandas_udf(_MANGLED)
def mangled_parts(names: pd.Series) -> pd.DataFrame:
    """Class, namespaces, method and role of a mangled name (?name@class@ns@@...); nulls for other names."""
    roles = {"?0": "constructor", "?1": "destructor", "?_7": "vftable", "?_G": "scalar_deleting_destructor", "?_E": "vector_deleting_destructor"}
    rows = []
    for n in names:
        if not isinstance(n, str) or not n.startswith("?") or "@@" not in n:
            rows.append((None, None, None, None))
            continue
        body = n[1:].split("@@", 1)[0]
        role = "method"
        for mark, r in roles.items():
            if body.startswith(mark):
                role, body = r, "@" + body[len(mark) :]
                break
        parts = body.split("@")
        scope = [p for p in parts[1:] if p]
        rows.append((scope[0] if scope else None, list(reversed(scope[1:])), parts[0] or None, role if scope else "function"))
    return pd.DataFrame(rows, columns=["class_name", "namespaces", "method", "role"])


_PARAMETERS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("name", T.StringType())]))


@F.pandas_udf(_PARAMETERS)
def signature_parameters(signatures: pd.Series) -> pd.Series:
    """(type, name) of a signature's parameters, by balanced parentheses; the last word is the name, with its stars at the type."""

    def one(t: str | None):
        if not t or "(" not in t:
            return None
        depth, start, parts = 0, 0, []
        for i, ch in enumerate(t):
            if ch in "(<[":
                depth += 1
                if depth == 1 and ch == "(":
                    start = i + 1
            elif ch in ")>]":
                depth -= 1
                if not depth and ch == ")":
                    parts.append(t[start:i])
                    break
            elif ch == "," and depth == 1:
                parts.append(t[start:i])
                start = i + 1
        else:
            return None
        out = []
        for p in (p.strip() for p in parts):
            if not p or p == "void":
                continue
            head, _, name = p.rpartition(" ")
            stars = len(name) - len(name.lstrip("*&"))
            out.append(((head + " " + name[:stars]).strip() if head else p, name[stars:] if head else None))
        return out

    return signatures.map(one, na_action="ignore")


# Patterns of parameters that carry outside data.
SURFACE = {
    "buffer": r"(?i)\b(void|char|byte|uint8_t|_BYTE)\s*\*",
    "text": r"(?i)\b(wchar_t|LPC?W?STR|PCW?STR|BSTR|std::w?string)\b",
    "length": r"(?i)\b(size_t|cb\w*|cch\w*|len\w*|\w*size)\b",
    "handle": r"(?i)\b(HANDLE|SOCKET|HKEY|FILE\s*\*)",
    "interface": r"\bI[A-Z]\w+\s*\*",
    "variant": r"(?i)\b(VARIANT|SAFEARRAY|PROPVARIANT)\b",
}


def parameter_surface(signature: Column) -> Column:
    """A struct of booleans: which kinds of outside data the parameters can carry."""
    inner = F.coalesce(F.regexp_extract(signature, r"\((.*)\)", 1), F.lit(""))
    return F.struct(*[inner.rlike(p).alias(n) for n, p in SURFACE.items()])


def assigned_from(code: Column, callee: str) -> Column:
    """Names that are assigned the result of a call of the callee."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(rf"(\w+)\s*=\s*(?:\([^()]*\)\s*)?{re.escape(callee)}\s*\("), F.lit(1)))


def first_matching(c: Column, patterns: Sequence[tuple[str, str]], otherwise: str = "other") -> Column:
    """The name of the first pattern that a text matches in any case."""
    out = None
    for name, p in patterns:
        hit = c.rlike(f"(?i){p}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.coalesce(out, F.lit(otherwise)) if out is not None else F.lit(otherwise)


# Risk of types that callers send; arrays of others count .6 at least.
WIRE_RISK = {
    "string": 0.8, "byte[]": 0.9, "sbyte[]": 0.9, "int": 0.3, "uint": 0.3, "long": 0.3, "ulong": 0.3, "short": 0.3, "ushort": 0.3, "char": 0.3, "double": 0.3, "float": 0.3,
    "bool": 0.1, "System.Guid": 0.2, "NdrContextHandle": 0.2, "NdrEnum16": 0.2, "NdrInt3264": 0.4, "NdrUInt3264": 0.4, "NdrEmpty": 0.0, "NdrUnsupported": 0.1,
    "NdrInterfacePointer": 0.7, "NdrSystemHandle": 0.7, "IntPtr": 0.5,
}


def wire_type_risk(c: Column) -> Column:
    """The risk, 0 to 1, of a parameter's type as a stub writes it; .5 for types that aren't listed, null for null."""
    base, array = F.regexp_replace(c, r"[\[\]]+$", ""), c.endswith("[]")
    listed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WIRE_RISK.items() for x in kv]), base), F.lit(0.5))
    out = F.when(array & base.isin("byte", "sbyte"), 0.9).when(array & (base == "string"), 0.85).when(F.startswith(c, F.lit("NdrPipe")), 0.75).when(c.isin("NdrInterfacePointer", "NdrSystemHandle"), 0.7)
    out = out.when(array, F.greatest(listed, F.lit(0.6))).when(base.rlike("^(Struct|Union)_"), 0.6)
    return F.when(c.isNotNull(), out.otherwise(listed))


# What a method is for, by parts of its name; the first that matches counts.
METHOD_KINDS = (
    ("authentication", "(auth|login|credential|token|identity|impersonat)"),
    ("crypto", "(crypt|encrypt|decrypt|hash|sign|verify|cert)"),
    ("file_io", "(file|folder|directory|path|stream|storage|read|write|open|create|delete)(?!.*async)"),
    ("network", "(network|socket|http|url|connect|download|upload|remote)"),
    ("process", "(process|launch|execute|run|spawn|shutdown|reboot)"),
    ("registry", "(registry|regkey|hkey)"),
    ("system_management", "(system|update|install|config|setting|policy|timezone|power)"),
    ("elevation", "(elevat|admin|privilege|uac|consent)"),
    ("marshalling", "(marshal|unmarshal|proxy|stub|interface)"),
    ("data_access", "(get_|put_|set_|query|enum|list|find|search|exists|tryget|add|remove)"),
    ("event", "(add_|remove_|event|changed|notify|callback)"),
    ("async_operation", "(async|await|operation|task)"),
)


def method_kind(name: Column) -> Column:
    return first_matching(name, METHOD_KINDS)
