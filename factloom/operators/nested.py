"""Deeply nested JSON texts as flat child tables that keep their parent links.

Each record is parsed on its own into (path, ordinals, value) triples; triples are grouped by
their nearest repeated ancestor, and each group is pivoted into rows of one table.  All of this
happens inside the task that reads the record, so there is no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: In a path, the place of an array's elements.
EACH = "*"

Path = tuple[str, ...]


@dataclass(frozen=True)
class Child:
    """A child table: its name and the path of its elements (ending in EACH).

    instead: paths of arrays that count as this table where their sibling isn't there.
    """

    name: str
    path: Path
    instead: tuple[Path, ...] = field(default=())


class NotJson(ValueError):
    pass


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None}


def scan(text: str):
    """Parse JSON with an explicit stack: any depth, whole texts only."""
    at, n = 0, len(text)
    stack: list = []
    key: str | None = None
    done, result, expect = False, None, "value"
    while True:
        at = _BLANK.match(text, at).end()
        if done and not stack:
            if at != n:
                raise NotJson("something follows the value")
            return result
        if at >= n:
            raise NotJson("it ends early")
        ch = text[at]
        if expect == "key":
            if ch == "}" and not stack[-1][0]:
                value, at = stack.pop()[0], at + 1
            elif ch == '"':
                key, at = json.decoder.scanstring(text, at + 1, True)
                at = _BLANK.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise NotJson("a key without a value")
                stack[-1][1], at, expect = key, at + 1, "value"
                continue
            else:
                raise NotJson("no key")
        elif expect == "next":
            box = stack[-1]
            if ch == ",":
                at, expect = at + 1, "key" if isinstance(box[0], dict) else "value"
                box[2] = True
                continue
            if ch != ("}" if isinstance(box[0], dict) else "]"):
                raise NotJson("no end of the container")
            value, at = stack.pop()[0], at + 1
        elif ch == "{":
            stack.append([{}, None, False])
            at, expect = at + 1, "key"
            continue
        elif ch == "[":
            stack.append([[], None, False])
            at += 1
            continue
        elif ch == "]" and stack and isinstance(stack[-1][0], list) and not stack[-1][0] and not stack[-1][2]:
            value, at = stack.pop()[0], at + 1
        elif ch == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
        elif m := _NUMBER.match(text, at):
            value, at = (float if m.group(1) or m.group(2) else int)(m.group()), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise NotJson("no value")
            value, at = _WORDS[word], at + len(word)
        if stack:
            box = stack[-1]
            if isinstance(box[0], dict):
                box[0][box[1]] = value
            else:
                box[0].append(value)
            expect = "next"
        else:
            done, result = True, value


def _refuse(word: str):
    raise NotJson(word)


_decode = json.JSONDecoder(parse_constant=_refuse).decode


def parse(text: str):
    """One JSON text, by the fast decoder, or by scan() where that one can't go deep enough."""
    try:
        return _decode(text)
    except RecursionError:
        return scan(text)


def parse_through(text: str):
    """Parse a text; while the result is a string that itself is JSON, parse that one too.

    A string that begins like an object or array but isn't whole is no JSON (NotJson).
    """
    value = parse(text)
    while isinstance(value, str):
        try:
            value = parse(value)
        except ValueError:
            if value.lstrip()[:1] in ("[", "{"):
                raise NotJson("cut off inside a string") from None
            return value
    return value


def _inner(value):
    """An object or array written as a string inside the record, else the value itself."""
    if isinstance(value, str) and value[:1] in ("[", "{", " ") and value.strip()[:1] in ("[", "{"):
        try:
            return parse(value)
        except ValueError:
            return value
    return value


#: Texts of more characters are read as a stream of triples, so that the parsed record is never held whole.
STREAMED = 65_536


class _Empty:
    __slots__ = ()


#: The values of {} and [], which have no leaves.
EMPTY, EMPTY_LIST = _Empty(), _Empty()


def triples(value, repeated: frozenset[Path]) -> Iterator[tuple[Path, tuple[int, ...], object]]:
    """(path, ordinals, scalar) of each leaf, in no particular order.

    A lone value at the path of a repeated element is an array of one.  Empty objects and arrays give
    EMPTY and EMPTY_LIST.
    """
    stack = [((), (), value)]
    while stack:
        path, at, v = stack.pop()
        v = _inner(v)
        below = (*path, EACH)
        if isinstance(v, list):
            if not v:
                yield path, at, EMPTY_LIST
            for i, x in enumerate(v):
                stack.append((below, (*at, i), x))
        elif below in repeated:
            stack.append((below, (*at, 0), v))
        elif isinstance(v, dict):
            if not v:
                yield path, at, EMPTY
            for k, x in v.items():
                stack.append(((*path, k), at, x))
        else:
            yield path, at, v


_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|(")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null))')


def streamed(text: str, repeated: frozenset[Path]) -> Iterator[tuple[Path, tuple[int, ...], object]]:
    """The triples of triples(parse_through(text)), while the text is read: what is held is one path, not the record.

    NotJson is raised where the text turns out not to be whole; what was given before doesn't count then.
    Texts whose outermost value is a string are read through it.  Of a repeated key every value comes out, in order, so that
    the last one counts, as in parse(); a value's leaves below an earlier one stay if the later one has no such leaf.
    """
    at, n = 0, len(text)
    stack: list[list] = []  # [is it a list, path of its elements or of itself, ordinals, next index or None, is it empty]
    place: tuple[Path, tuple[int, ...]] | None = ((), ())  # of the value to come; None: after a value
    key_due = False
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            if text[at:].strip(" \t\n\r"):
                raise NotJson("no token")
            if stack or place is not None:
                raise NotJson("it ends early")
            return
        mark, quote, number, word = m.groups()
        at = m.end()
        if not stack and place is None:
            raise NotJson("something follows the value")
        if quote:
            string, at = json.decoder.scanstring(text, at, True)
            if key_due:
                m = _TOKEN.match(text, at)
                if m is None or m.group(1) != ":":
                    raise NotJson("a key without a value")
                at, key_due = m.end(), False
                top = stack[-1]
                top[4] = False
                place = ((*top[1], string), top[2])
                continue
            if place is None:
                raise NotJson("a value without a comma")
            if not stack:  # the outermost value
                value = parse_through(text)
                yield from triples(value, repeated) if value is not None else ()
                return
            yield from _placed(string, place, repeated)
            place = None
        elif number is not None or word:
            if place is None or key_due:
                raise NotJson("a value out of place")
            value = _WORDS[word] if word else (float(number) if any(c in number for c in ".eE") else int(number))
            if stack or value is not None:
                yield from _placed(value, place, repeated)
            place = None
        elif mark in "[{":
            if place is None or key_due:
                raise NotJson("a value out of place")
            path, ordinals = place
            if mark == "[":
                stack.append([True, (*path, EACH), ordinals, 0, True])
                place = ((*path, EACH), (*ordinals, 0))
            else:
                if (*path, EACH) in repeated:  # a lone value is an array of one
                    path, ordinals = (*path, EACH), (*ordinals, 0)
                stack.append([False, path, ordinals, None, True])
                place, key_due = None, True
        elif mark in "]}":
            top = stack[-1] if stack else None
            if top is None or top[0] != (mark == "]") or not top[4] and (key_due or place is not None):
                raise NotJson("an end out of place")
            stack.pop()
            if top[4]:
                yield (top[1][:-1], top[2], EMPTY_LIST) if top[0] else (top[1], top[2], EMPTY)
            place, key_due = None, False
        elif mark == ",":
            top = stack[-1] if stack else None
            if top is None or place is not None or key_due:
                raise NotJson("a comma out of place")
            if top[0]:
                top[3] += 1
                place = (top[1], (*top[2], top[3]))
            else:
                key_due = True
        else:
            raise NotJson("a colon out of place")
        if stack and place is None and not key_due and stack[-1][4] and not (mark in ("[", "{") if mark else False):
            stack[-1][4] = False  # it has a value now


def _placed(value, place: tuple[Path, tuple[int, ...]], repeated: frozenset[Path]) -> Iterator[tuple[Path, tuple[int, ...], object]]:
    """The triples of a scalar, or of the object or array that a string holds, at its place."""
    path, ordinals = place
    if isinstance(value, str) and isinstance(inner := _inner(value), (dict, list)):
        below = frozenset(p[len(path) :] for p in repeated if p[: len(path)] == path)
        for p, at, v in triples(inner, below):
            yield (*path, *p), (*ordinals, *at), v
        return
    while (*path, EACH) in repeated:
        path, ordinals = (*path, EACH), (*ordinals, 0)
    yield path, ordinals, value


def _ancestor(path: Path) -> int:
    """Length of the path of the nearest repeated ancestor (0: the record itself)."""
    for i in range(len(path), 0, -1):
        if path[i - 1] == EACH:
            return i
    return 0


def pivot(rows: Iterator[tuple[Path, tuple[int, ...], object]]) -> dict[Path, dict[tuple[int, ...], dict[Path, object]]]:
    """Group triples by repeated ancestor: table path -> ordinals -> (path below the element -> value).

    Elements that are null and markers of a cut array (objects with _truncated) get no row, though
    they keep their ordinal.  Parents of a row get a row too.
    """
    tables: dict[Path, dict[tuple[int, ...], dict[Path, object]]] = {}
    cut: list[tuple[Path, tuple[int, ...]]] = []
    length: dict[Path, int] = {}

    def row_of(path: Path, at: tuple[int, ...]) -> dict[Path, object]:
        table = tables.get(path)
        if table is None:
            table = tables[path] = {}
        row = table.get(at)
        if row is None:
            row = table[at] = {}
            if len(at) > 1:
                row_of(path[: _ancestor(path[:-1])], at[:-1])
        return row

    for path, at, v in rows:
        n = length.get(path)
        if n is None:
            n = length[path] = _ancestor(path)
        if not n:
            continue
        rel = path[n:]
        if v is None and not rel:
            if len(at) > 1:
                row_of(path[: _ancestor(path[:-1])], at[:-1])
            continue
        if rel == ("_truncated",):
            cut.append((path[:n], at))
        row = row_of(path[:n], at)
        if v is not EMPTY and v is not EMPTY_LIST:
            row[rel] = v
    for path, at in cut:
        tables[path].pop(at, None)
    return tables


def _text(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v)


SCHEMA = T.StructType([T.StructField("child", T.StringType()), T.StructField("parent_pos", T.IntegerType()), T.StructField("pos", T.IntegerType())])


class Flattener:
    """The per-record work; built once per task."""

    def __init__(self, children: Sequence[Child]):
        self.where: dict[Path, tuple[str, Path | None]] = {}
        for c in children:
            self.where[c.path] = (c.name, None)
            for p in c.instead:
                self.where[p] = (c.name, c.path[:-1])
        self.repeated = frozenset(self.where)

    def rows(self, text: str | None) -> Iterator[tuple[str, int, int, dict[Path, object]]]:
        """(child, parent_pos, pos, fields) of one text; none for null, blank and broken texts."""
        if not text:
            return
        try:
            if len(text) > STREAMED:
                found, tables = None, pivot(streamed(text, self.repeated))
            else:
                value = parse_through(text)
                if value is None:
                    return
                found = list(triples(value, self.repeated))
                tables = pivot(iter(found))
        except ValueError:
            return
        shown: set[tuple[Path, tuple[int, ...]]] | None = None
        for path, (name, rather) in self.where.items():
            if path not in tables:
                continue
            if rather is not None:
                if shown is None:  # elements that have the first choice, be it null or empty of rows
                    again = found if found is not None else streamed(text, self.repeated)  # a long text is read once more
                    wanted = [(q, sum(x == EACH for x in q)) for q in (w for _, w in self.where.values() if w)]
                    shown = {(q, at[:k]) for p, at, _ in again for q, k in wanted if p[: len(q)] == q}
                depth = sum(x == EACH for x in rather)
                for at, fields in tables[path].items():
                    if (rather, at[:depth]) not in shown:
                        yield name, at[-2] if len(at) > 1 else -1, at[-1], fields
            else:
                for at, fields in tables[path].items():
                    yield name, at[-2] if len(at) > 1 else -1, at[-1], fields


def child_tables(df: DataFrame, id_col: str, children: Mapping[str, Sequence[Child]], fields: bool = False) -> DataFrame:
    """Child rows of JSON text columns: (id, child, parent_pos, pos), with fields also a map path -> text.

    children: the child tables of each JSON column.  parent_pos is -1 at the top level.
    Null, empty, blank and broken texts have no children; other columns of df aren't read.
    A record of any depth is read; repeated rows give their children again.
    """
    names = list(children)
    src = df.select(id_col, *names)
    schema = T.StructType([df.schema[id_col], *SCHEMA.fields])
    if fields:
        schema = schema.add("fields", T.MapType(T.StringType(), T.StringType()))
    specs = {k: list(v) for k, v in children.items()}

    def run(batches):
        work = [Flattener(specs[n]) for n in names]
        for b in batches:
            id_type = b.schema.field(0).type
            ids = b.column(0)
            take, child, up, pos, maps = [], [], [], [], []
            for j, w in enumerate(work):
                for i, text in enumerate(b.column(j + 1).to_pylist()):
                    for name, parent, at, row in w.rows(text):
                        take.append(i)
                        child.append(name)
                        up.append(parent)
                        pos.append(at)
                        if fields:
                            maps.append([(".".join(p), _text(v)) for p, v in row.items()])
            cols = [ids.take(pa.array(take, pa.int64())).cast(id_type), pa.array(child, pa.string()), pa.array(up, pa.int32()), pa.array(pos, pa.int32())]
            if fields:
                cols.append(pa.array(maps, pa.map_(pa.string(), pa.string())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def elements(value) -> Iterator[object]:
    """The elements of a parsed array as child_tables sees them: a lone value is an array of one, nulls and markers of a cut array are none."""
    for x in value if isinstance(value, list) else [value]:
        x = _inner(x)
        if x is not None and not (isinstance(x, dict) and "_truncated" in x):
            yield x


def path_nodes(value) -> list[str]:
    """The nodes of a parsed path: a step's text or function; of any other step all its leaves, in one text."""

    def node(x) -> str:
        if isinstance(x, dict) and isinstance(f := x.get("function"), str):
            return f
        if isinstance(x, (dict, list)):
            return json.dumps(sorted([".".join(p), list(at), repr(v) if not isinstance(v, _Empty) else ""] for p, at, v in triples(x, frozenset())))
        return _text(x)

    return [node(x) for x in elements(value)]


def difficulties(value) -> list[str]:
    """The bypass difficulties of parsed guards: one for each guard that has the field, 'unknown' where that is null."""
    found = (x["bypass_difficulty"] for x in elements(value) if isinstance(x, dict) and "bypass_difficulty" in x)
    return [x if isinstance(x, str) else "unknown" for x in found]


def text_arrays(df: DataFrame, json_col: str, out: str, read: Callable[[object], list[str]]) -> DataFrame:
    """The other columns of df, and as `out` what read() makes of each JSON text; rows with null, blank and broken texts and JSON null are left out."""
    keep = [c for c in df.columns if c != json_col]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.StringType()))])

    def run(batches):
        for b in batches:
            take, arrays = [], []
            for i, text in enumerate(b.column(len(keep)).to_pylist()):
                try:
                    value = parse_through(text) if text else None
                except ValueError:
                    continue
                if value is not None:
                    take.append(i)
                    arrays.append([x.encode(errors="backslashreplace").decode() for x in read(value)])
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(len(keep))), pa.array(arrays, pa.list_(pa.string()))], names=schema.names)

    return df.select(*keep, json_col).mapInArrow(run, schema)


def triple_table(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """All leaves of a JSON text column: (id, path, ordinals, value), arrays as they stand."""
    schema = T.StructType([df.schema[id_col], T.StructField("path", T.StringType()), T.StructField("ordinals", T.ArrayType(T.IntegerType())), T.StructField("value", T.StringType())])

    def run(batches):
        for b in batches:
            take, paths, at, values = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                try:
                    value = parse_through(text) if text else None
                except ValueError:
                    continue
                for p, o, v in triples(value, frozenset()) if value is not None else ():
                    take.append(i)
                    paths.append(".".join(p))
                    at.append(list(o))
                    values.append(None if isinstance(v, _Empty) else _text(v))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(paths, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.string())], names=schema.names)

    return df.select(id_col, json_col).mapInArrow(run, schema)


# The nested parts of a finding.
FINDING_CHILDREN = {
    "guards_json": (Child("guard", (EACH,)), Child("check", (EACH, "checks", EACH), ((EACH, "conditions", EACH),))),
    "path_json": (Child("step", (EACH,)), Child("site", (EACH, "sites", EACH))),
    "extra_json": (
        Child("affected", ("affected_functions", EACH)),
        Child("mitigation", ("mitigations_present", EACH)),
        Child("hop", ("data_flow", "hops", EACH)),
        Child("ref", ("data_flow", "hops", EACH, "refs", EACH)),
    ),
}
