"""Token ids of every text by a public byte-level tokenizer.

Short texts are encoded in one go.  Long ones are halved into leaves that are encoded in parallel
tasks; neighbouring results are then joined in a tree, by encoding a growing window around each join
until it agrees with what lies on both sides.  The result is exactly that of encoding the whole text.
"""

from __future__ import annotations

import base64
import functools
import math
import os
from collections.abc import Sequence

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import cut

#: Where the vocabulary files lie, and the one used if none is named.
FOLDER = os.environ.get("FACTLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a leaf; longer texts are halved.
LEAF = 8_192
#: Neighbouring parts that one task joins in a round of the tree.
FAN = 16

# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space between two non-blanks always begins a piece, so a text can be cut there.
_CUT = regex.compile(r"(?<=\S) (?=\S)")
#: The pattern looks at most so far beyond a piece.
_AHEAD = 4


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN)
        self.bytes_of = {v: k for k, v in ranks.items()}

    def direct(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(text)

    def _piece(self, data: bytes) -> list[int]:
        """One piece; a long one by halves."""
        if len(data) <= LEAF:
            return self.enc._encode_single_piece(data)
        half = len(data) // 2
        return self._join_piece(self._piece(data[:half]), self._piece(data[half:]))

    def _text(self, ids: Sequence[int]) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)

    def _join_piece(self, a: list[int], b: list[int]) -> list[int]:
        """Join two encoded halves of one piece.

        A sequence of tokens is the piece's encoding just if each two neighbours encode to themselves.
        So a window whose outer tokens come out as they stand on either side proves the whole.
        """
        if not a or not b:
            return a or b
        k = 4
        while True:
            left, right = a[-k:], b[:k]
            mid = self.enc._encode_single_piece(self._text(left) + self._text(right))
            whole_left, whole_right = len(left) == len(a), len(right) == len(b)
            if (whole_left or mid[0] == left[0]) and (whole_right or mid[-1] == right[-1]):
                return a[: len(a) - len(left)] + mid + b[len(right) :]
            k *= 2

    def join(self, ta: str, a: list[int], tb: str, b: list[int]) -> list[int]:
        """The encoding of ta + tb from those of ta and tb."""
        if not ta or not tb:
            return a or b
        # the last sure boundary of ta that what follows can't move
        width, start = 64, 0
        while width < len(ta):
            found = [m.start() for m in _CUT.finditer(ta, len(ta) - width, len(ta) - _AHEAD)]
            if found:
                start = found[-1]
                break
            width *= 2
        both = ta[start:] + tb
        seam = len(ta) - start
        own = [m.start() for m in self.pieces.finditer(ta, start)]  # boundaries as ta has them
        own = [p - start for p in own] + [seam]
        known = set(own)
        ends_b = (m.end() for m in self.pieces.finditer(tb))
        next_b = next(ends_b, None)
        out: list[tuple[int, int]] = []
        stop = len(both)
        for m in self.pieces.finditer(both):
            out.append((m.start(), m.end()))
            if m.end() >= seam:
                while next_b is not None and next_b < m.end() - seam:
                    next_b = next(ends_b, None)
                if next_b is not None and next_b == m.end() - seam:
                    stop = m.end()
                    break
        # pieces that ta has as well keep their tokens
        same = 0
        while same < len(out) and out[same][1] < seam and own[same] == out[same][0] and own[same + 1] == out[same][1]:
            same += 1
        begin = out[same][0] if same < len(out) else seam
        tail = self._take_back(a, len(ta[start + begin :].encode()))
        head = self._take(b, len(tb[: stop - seam].encode()))
        middle: list[int] = []
        for p, q in out[same:]:
            if p < seam < q and q - p > LEAF and p in known and not any(p < x < seam for x in known) and q == stop:
                # one piece over the join, whose halves are encoded already
                first_b = self.pieces.match(tb)
                if first_b is not None and first_b.end() == q - seam:
                    middle += self._join_piece(a[len(a) - tail :], b[:head])
                    continue
            middle += self._piece(both[p:q].encode())
        return a[: len(a) - tail] + middle + b[head:]

    def _take_back(self, ids: list[int], size: int) -> int:
        n = 0
        while size > 0:
            n += 1
            size -= len(self.bytes_of[ids[-n]])
        return n

    def _take(self, ids: list[int], size: int) -> int:
        n = 0
        while size > 0:
            size -= len(self.bytes_of[ids[n]])
            n += 1
        return n

    def joined(self, parts: list[tuple[str, list[int]]]) -> list[int]:
        """Join neighbouring leaves pair by pair until one is left."""
        while len(parts) > 1:
            parts = [
                (parts[i][0] + parts[i + 1][0], self.join(*parts[i], *parts[i + 1])) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)
            ]
        return parts[0][1] if parts else []

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """The whole text in this task."""
        if len(text) <= leaf:
            return self.direct(text)
        return self.joined([(t, self.direct(t)) for t in halves(text, leaf)])


def halves(text: str, leaf: int = LEAF) -> list[str]:
    """Halve a text until no part is longer than a leaf."""
    if len(text) <= leaf:
        return [text]
    at = len(text) // 2
    return [*halves(text[:at], leaf), *halves(text[at:], leaf)]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path(folder: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(folder or FOLDER, name)


def encode(df: DataFrame, ident: str, text: str, path: str | None = None, counts_only: bool = False, leaf: int = LEAF, carry: Sequence[str] = ()) -> DataFrame:
    """(id, carried columns, ids) of every row, or n_tokens in place of ids.

    Null and empty texts give an empty list (0 tokens).  Strings that look like special tokens are plain
    text.  A text of any length is encoded whole; its leaves are encoded by different tasks.
    Repeated rows come out each, whatever their ids.
    """
    path = path or vocabulary_path()
    kept = [df.schema[c] for c in (ident, *carry)]
    last = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([*kept, last])
    k = len(kept)

    def result(lists):
        return pa.array([len(x) for x in lists], pa.int64()) if counts_only else pa.array(lists, pa.list_(pa.int32()))

    def short(batches):
        e = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:k], result([e.direct(t) if t else [] for t in b.column(k).to_pylist()])], names=schema.names)

    def leaves(batches):
        for b in batches:
            take, at, parts = [], [], []
            for i, t in enumerate(b.column(k + 1).to_pylist()):
                for j, part in enumerate(halves(t, leaf)):
                    take.append(i)
                    at.append(j)
                    parts.append(part)
            idx = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(idx) for c in b.columns[: k + 1]), pa.array(at, pa.int32()), pa.array(parts, pa.string())], names=[*schema.names[:k], "__row", "__k", "__t"])

    def leaf_ids(batches):
        e = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([e.direct(t) for t in b.column(k + 2).to_pylist()], pa.list_(pa.int32()))], names=[*schema.names[:k], "__row", "__k", "__t", "__ids"])

    def tree(batches):
        """One round: neighbouring parts of a text joined, in pairs of pairs."""
        e = encoder(path)
        for b in batches:
            parts = b.column(k + 2).to_pylist()
            lists = [e.joined([(x["__t"], x["__ids"]) for x in p]) for p in parts]
            yield pa.RecordBatch.from_arrays([*b.columns[: k + 2], pa.array(["".join(x["__t"] for x in p) for p in parts], pa.string()), pa.array(lists, pa.list_(pa.int32()))], names=id_schema.names)

    def finished(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:k], result(b.column(k).to_pylist())], names=schema.names)

    src = df.select(ident, *carry, text)
    is_long = F.length(text) > leaf
    small = src.where(F.col(text).isNull() | ~is_long).mapInArrow(short, schema)
    leaf_schema = T.StructType([*kept, T.StructField("__row", T.LongType()), T.StructField("__k", T.IntegerType()), T.StructField("__t", T.StringType())])
    id_schema = T.StructType([*leaf_schema.fields, T.StructField("__ids", T.ArrayType(T.IntegerType()))])
    names = [f.name for f in kept]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that a task that runs again finds the same numbers
    numbered = cut(src.where(is_long).withColumn("__row", F.monotonically_increasing_id()).select(*names, "__row", text))
    parts = numbered.mapInArrow(leaves, leaf_schema).repartition(tasks, "__row", "__k").mapInArrow(leaf_ids, id_schema)
    # a round joins FAN neighbours in a task of their own; the longest text says how many rounds it takes
    width = 2 ** math.ceil(math.log2(max(1, -(-(numbered.agg(F.max(F.length(text))).first()[0] or 0) // leaf))) + 1)
    while width > 1:
        width = -(-width // FAN)
        parts = parts.groupBy(*names, "__row", F.expr(f"__k div {FAN}").cast("int").alias("__k")).agg(F.array_sort(F.collect_list(F.struct("__k", "__t", "__ids"))).alias("__p")).mapInArrow(tree, id_schema)
    return small.unionByName(parts.select(*names, "__ids").mapInArrow(finished, schema))
