"""Telling new records from those that any earlier batch stored, without reprocessing the history.

The records of each batch become an immutable segment: a suffix array, sorted suffixes of the batch's
texts.  A new record's substrings are found in the segments by binary search, the long matches are summed
to a coverage per stored record, and segments are merged when they are of like size, so that a record
is searched in about log2(batches) segments.  Segments lie in a store in the shared folder; a later batch
reads them and itself, never the rows that made them.

Suffixes are spread over shards by a hash of the window of text that they begin with.  Matches are at
least a window long, so suffixes that match lie in one shard, and shards are worked on independently.
"""

from __future__ import annotations

import json
import re
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.skew import fragment_replicate_join, lookup_join
from factloom.session import cut, own_folder, read_text, remove, replace_text

#: Ends a record's text in a segment, so that a match that holds it reaches the end of both records.
END = "\x03"
#: Records that one shard should hold, and probes of one window that one shard should look up.
PER_SHARD, PER_WINDOW = 100_000, 1_000
#: Words of a window and the share of a text that matches have to cover.
WORDS, SHARE = 5, 0.8


class Segment:
    """An immutable suffix array: sorted suffixes and the records that they come from."""

    __slots__ = ("suffixes", "refs")

    def __init__(self, suffixes: list[str], refs: list):
        self.suffixes, self.refs = suffixes, refs

    @classmethod
    def of(cls, entries: Sequence[tuple[str, object]]) -> Segment:
        pairs = sorted(entries, key=lambda x: x[0])
        return cls([s for s, _ in pairs], [r for _, r in pairs])

    @classmethod
    def merged(cls, a: Segment, b: Segment) -> Segment:
        pairs = sorted([*zip(a.suffixes, a.refs), *zip(b.suffixes, b.refs)], key=lambda x: x[0])  # two sorted runs: a linear merge
        return cls([s for s, _ in pairs], [r for _, r in pairs])

    def matches(self, suffix: str, least: int) -> Iterator[tuple[object, int]]:
        """(record, length) of each stored suffix that begins with at least `least` characters of this one.

        They lie side by side around the place where the suffix would be; lengths only fall with the distance.
        """
        at = bisect_left(self.suffixes, suffix)
        for step, i in ((-1, at - 1), (1, at)):
            common = len(suffix)
            while 0 <= i < len(self.suffixes):
                s = self.suffixes[i]
                n = min(common, len(s))
                if suffix[:n] != s[:n]:
                    low = 0
                    while low < n:  # the common length, by halves
                        mid = (low + n + 1) // 2
                        low, n = (mid, n) if suffix[:mid] == s[:mid] else (low, mid - 1)
                if n < least:
                    break
                common = n
                yield self.refs[i], n
                i += step


class History:
    """Segments of falling sizes."""

    def __init__(self) -> None:
        self.segments: list[Segment] = []

    def add(self, s: Segment) -> None:
        while self.segments and len(self.segments[-1].suffixes) <= len(s.suffixes):
            s = Segment.merged(self.segments.pop(), s)
        self.segments.append(s)

    def matches(self, suffix: str, least: int) -> Iterator[tuple[object, int]]:
        for s in self.segments:
            yield from s.matches(suffix, least)


def covered(spans: Sequence[tuple[int, int]]) -> int:
    """The length of a union of spans (start, end)."""
    end = total = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


class Store:
    """Generations of segments in a folder; each call that takes in records adds one, like-sized ones are merged.

    Without a path the folder lies in the shared one and goes with the application; a given path is kept for later ones.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or own_folder(spark, "segments")).rstrip("/")

    def generations(self, kind: str) -> list[dict]:
        """The live generations, oldest first: name, and rows where counted."""
        text = read_text(self.spark, f"{self.path}/{kind}.json")
        return json.loads(text) if text else []

    def tables(self, kind: str) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.path}/{kind}/{g['name']}") for g in self.generations(kind)]

    def add(self, kind: str, rows: DataFrame, sort: Sequence[str] = ()) -> None:
        """Write one generation, and merge the last ones while an older one is no larger than a newer one."""
        live = self.generations(kind)
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{kind}/{name}")
        live.append({"name": name})
        gone = []
        while len(live) > 1:
            for g in live[-2:]:
                if "rows" not in g:
                    g["rows"] = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{kind}/{g['name']}").count()
            a, b = live[-2:]
            if a["rows"] > b["rows"]:
                break
            both = self.spark.read.schema(rows.schema).parquet(*[f"{self.path}/{kind}/{g['name']}" for g in (a, b)])
            both = both.repartition(sort[0]).sortWithinPartitions(*sort) if sort else both
            name = uuid.uuid4().hex
            both.write.parquet(f"{self.path}/{kind}/{name}")
            gone += live[-2:]
            live[-2:] = [{"name": name, "rows": a["rows"] + b["rows"]}]
        replace_text(self.spark, f"{self.path}/{kind}.json", json.dumps(live))
        for g in gone:
            remove(self.spark, f"{self.path}/{kind}/{g['name']}")


def _shards(spark: SparkSession, records: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records // PER_SHARD))


def earliest(rows: DataFrame, text: str, order: Sequence[str], ident: str, store: Store | None = None) -> DataFrame:
    """(text, first id, n) of each text of these rows that an earlier row has, stored or new; first by the order columns, then by id.

    order: the batch first, then what orders rows inside one; nulls come first.  Rows of the store come before all
    new ones.  Rows are first combined per text and batch, which bounds what a text of very many rows brings along by
    the number of batches.  Each shard takes its batches in order: looks up the batch's texts in the segments
    so far, and makes a segment of those that are in none.  A match has to cover the whole text, so one suffix
    of each record, its start, is enough.  Null texts repeat nothing.  n counts new rows, and 1 for a stored first.
    The segments are added to the store.
    """
    spark = rows.sparkSession
    store = store or Store(spark)
    id_type = rows.schema[ident].dataType
    rest = F.struct(*[F.col(c) for c in order[1:]], F.col(ident).alias("__id"))
    per_batch = cut(
        rows.where(F.col(text).isNotNull())
        .groupBy(F.col(text).alias("suffix"), F.col(order[0]).alias("batch"))
        .agg(F.min(rest).alias("rest"), F.count(F.lit(1)).alias("n"))
        .withColumn("h", F.xxhash64("suffix"))
    )
    shards = _shards(spark, per_batch.count())
    shard = F.pmod("h", F.lit(shards)).cast("int").alias("shard")
    new = per_batch.select(shard, F.lit(1).alias("kind"), F.lit(0).alias("seg"), "batch", F.lit(None).cast("string").alias("sorted"), "rest", F.col("rest.__id").alias("rec"), "suffix", "n")
    for g, t in enumerate(store.tables("whole")):
        t = lookup_join(t, per_batch.select("h").distinct(), ["h"], "left_semi", spread_by=["suffix"])
        old = t.select(shard, F.lit(0).alias("kind"), (F.lit(g * 1_000) + F.col("seg")).alias("seg"), F.lit(None).cast(new.schema["batch"].dataType).alias("batch"), F.col("suffix").alias("sorted"), F.lit(None).cast(new.schema["rest"].dataType).alias("rest"), "rec", "suffix", F.lit(1).cast("bigint").alias("n"))
        new = new.unionByName(old)
    sent = new.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "seg", "sorted", "batch", "rest").select("shard", "kind", "seg", "batch", "rec", "suffix", "n")
    schema = T.StructType([T.StructField("found", T.BooleanType()), T.StructField("suffix", T.StringType()), T.StructField("rec", id_type), T.StructField("n", T.LongType()), T.StructField("seg", T.IntegerType())])

    def work(shard_rows: Iterator[tuple]) -> Iterator[tuple]:
        """One shard's rows in order: stored segments first, then the batches."""
        history, count, fresh = History(), {}, []
        for (kind, _, _), group in _grouped(shard_rows):
            if kind == 0:
                history.segments.append(Segment([s + END for _, s, _ in group], [r for r, _, _ in group]))
                continue
            if not fresh:
                fresh.append(len(history.segments))
            own = []
            for rec, s, n in group:
                q = s + END
                spans = [(r, m) for r, m in history.matches(q, len(q))]  # coverage of the whole text by one match
                first = spans[0][0] if spans else rec
                if spans:
                    count.setdefault(first, [s, 1])[1] += n
                elif n > 1:
                    count[rec] = [s, n]
                if not spans:
                    own.append((q, rec))
                    if n == 1:
                        count.setdefault(rec, [s, 1])
            if own:
                # batches' segments merge among themselves; stored ones stay as they are
                base, history.segments = history.segments[: fresh[0]], history.segments[fresh[0] :]
                history.add(Segment.of(own))
                history.segments = base + history.segments
        for r, (s, n) in count.items():
            if n > 1:
                yield True, s, r, n, 0
        for k, seg in enumerate(history.segments[fresh[0] if fresh else len(history.segments) :]):
            for s, r in zip(seg.suffixes, seg.refs):
                yield False, s[:-1], r, 1, k

    out = sent.mapInArrow(_by_shard(work, schema), schema)
    done = own_folder(spark, "taken")
    out.write.partitionBy("found").parquet(done)
    both = spark.read.schema(schema).parquet(done)
    store.add("whole", both.where("NOT found").select(F.xxhash64("suffix").alias("h"), "suffix", "rec", "seg"), sort=("h", "suffix"))
    return both.where("found").select(F.col("suffix").alias(text), F.col("rec").alias("first_id"), "n")


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same leading (kind, seg, batch), as ((kind, seg, batch), [(rec, suffix, n)])."""
    key, group = None, []
    for *k, rec, s, n in rows:
        if tuple(k) != key and group:
            yield key, group
            group = []
        key = tuple(k)
        group.append((rec, s, n))
    if group:
        yield key, group


def _by_shard(work, schema: T.StructType, size: int = 10_000):
    """A function for mapInArrow that runs work() over each shard's rows, which lie together."""
    arrow = [{T.BooleanType(): pa.bool_(), T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(f.dataType) for f in schema.fields]

    def run(batches):
        def stream():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        rows, current, ended = stream(), None, object()
        current = next(rows, ended)
        while current is not ended:
            shard = current[0]

            def mine():
                nonlocal current
                while current is not ended and current[0] == shard:
                    yield current[1:]
                    current = next(rows, ended)

            out: list[tuple] = []
            for r in work(mine()):
                out.append(r)
                if len(out) == size:
                    yield _record_batch(out, arrow, schema)
                    out = []
            if out:
                yield _record_batch(out, arrow, schema)
            for _ in mine():  # what work() left
                pass

    return run


def _record_batch(rows: list[tuple], arrow: list, schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names=schema.names)


def repeats(rows: DataFrame, text: str, order: Sequence[str], ident: str, store: Store | None = None) -> DataFrame:
    """(first_id, id) for each of these rows that repeats the text of an earlier one, stored or new; no row for the first ones.

    order: the batch first, then what orders rows inside a batch; ties go by id.
    """
    firsts = cut(earliest(rows, text, order, ident, store))
    known = firsts.select(text, F.col("n").alias("load"))
    joined = fragment_replicate_join(rows.select(text, ident), firsts.select(text, "first_id"), [text], loads=known, spread_by=[ident])
    return joined.where(F.col(ident) != F.col("first_id")).select("first_id", ident)


# ---------------------------------------------------------------- near copies

#: A word: letters and digits; in scripts without blanks between words, one sign.
_WORD = re.compile("[\u0e00-\u0e7f\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\\W_\u0e00-\u0e7f\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def windows_of(words: Sequence[str], size: int = WORDS) -> list[int]:
    """A hash of each window of so many words; of a shorter text one of the whole."""
    return [xxhash.xxh64_intdigest(" ".join(words[i : i + size])) - (1 << 63) for i in range(max(1, len(words) - size + 1))] if words else []


def probes_of(weights: Sequence[int], words: int, share: float = SHARE, size: int = WORDS) -> list[int]:
    """Windows (by place) to look up, given in how many records each one is.

    The most frequent windows are left out as long as they alone couldn't cover the share of the text: any
    record that covers it has one of the others.  So common windows are looked up by few records.
    """
    left = np.zeros(words, bool)
    out = []
    by_count = sorted(range(len(weights)), key=lambda i: (-weights[i], i))
    need = share * words - 1e-9
    for k, i in enumerate(by_count):
        fresh = ~left[i : i + size]
        if left.sum() + fresh.sum() >= need:
            out = by_count[k:]
            break
        left[i : i + size] = True
    return [i for i in out if weights[i] > 1]


def covered_words(qh: pa.Array, th: pa.Array, size: int = WORDS) -> np.ndarray:
    """For each row, how many words of the first list's text its windows that the second list has cover.  Whole batches at once."""
    lengths = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (qh, th)]
    values = [x.flatten().to_numpy(zero_copy_only=False) for x in (qh, th)]
    row = [np.repeat(np.arange(len(n)), n) for n in lengths]
    if not len(values[0]):
        return np.zeros(len(qh), np.int64)
    seen, code = np.unique(np.concatenate(values), return_inverse=True)
    key = np.concatenate(row) * len(seen) + code  # a number for each pair of row and window
    hit = np.nonzero(np.isin(key[: len(values[0])], key[len(values[0]) :]))[0]
    r, at = row[0][hit], hit - np.repeat(np.cumsum(lengths[0]) - lengths[0], lengths[0])[hit]
    gain = np.full(len(hit), size)
    same = r[1:] == r[:-1]
    gain[:-1][same] = np.minimum(size, (at[1:] - at[:-1])[same])  # what the next window covers again counts there
    return np.bincount(r, gain, minlength=len(qh)).astype(np.int64)


def near_repeats(rows: DataFrame, text: str, order: Sequence[str], ident: str, store: Store | None = None, share: float = SHARE, size: int = WORDS, fold: Callable[[DataFrame], DataFrame] | None = None, each: bool = False) -> DataFrame:
    """(id, stored_id, coverage): earlier texts, stored or new, that cover at least the share of a new text's words by windows they have in common.

    One row per pair of different texts, each under the id of its first row; copies of a text are no pairs
    (see repeats()).  A text of fewer words than a window is one window of its own.  Every such pair comes out.  Candidates come from a
    binary search of each text's rarest windows (probes_of) in the segments of all batches so far; then all
    windows of both texts are compared.  Windows of very many probes are spread over several shards.
    Null, empty and blank texts are left out.  Texts and segments are added to the store, if one is given.  fold: makes of the pairs what is
    kept, such as nearest(), before they are written.

    each: (id, stored_id, coverage, links) instead, one row per row of these and different text that an earlier row has, its own text (coverage 1)
    among them; a text is told by the id of its first row.  So copies of a text have their links too, also to texts stored
    after its first row.  links: how many rows the id has.
    """
    if each and fold:
        raise ValueError("fold is for pairs of texts")
    spark = rows.sparkSession
    id_type = rows.schema[ident].dataType
    o = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(ident).alias("rec"))
    rows = rows.where(F.col(text).rlike(r"\S")).select(F.col(text).alias("text"), F.col(ident).alias("id"), o.alias("at"))
    told = rows.groupBy("text").agg(F.min("at").alias("o"), F.max("at").alias("last"), F.count(F.lit(1)).alias("load"))
    told = cut(told) if each else told.withColumn("last", F.col("o"))
    firsts, known = told, store.tables("texts") if store else []
    for t in known:
        firsts = lookup_join(firsts, t.select("text"), ["text"], "left_anti", spread_by=["text"])
    firsts = firsts.select(F.col("o.rec").alias("rec"), "o", "text", "last", "load")
    made = T.StructType([*firsts.schema.fields, T.StructField("words", T.ArrayType(T.StringType())), T.StructField("hs", T.ArrayType(T.LongType()))])

    def split(batches):
        for b in batches:
            words = [words_of(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words, pa.list_(pa.string())), pa.array([windows_of(w, size) for w in words], pa.list_(pa.int64()))], names=made.names)

    new = cut(firsts.mapInArrow(split, made))
    asking = new  # the texts that look others up: with each, stored ones that come again, too
    for t in known if each else []:
        again = lookup_join(t.select("rec", "text", "words", "hs"), told.select("text", "last", "load"), ["text"], spread_by=["rec"])
        asking = asking.unionByName(again.withColumn("o", F.lit(None).cast(new.schema["o"].dataType)))
    asking = cut(asking) if known and each else asking
    entry = lambda t, at: t.select("rec", F.col(f"{at}.o0").alias("batch"), F.size("words").alias("n"), "words", F.posexplode("hs").alias("i", "h")).select("rec", "batch", "n", "i", "h", F.array_join(F.slice("words", F.col("i") + 1, size), " ").alias("suffix"))
    mine, asked = entry(new, "o"), entry(asking, "last")
    old = store.tables("windows") if store else []
    old_windows = None
    for g, t in enumerate(old):
        t = lookup_join(t, asked.select("h").distinct(), ["h"], "left_semi", spread_by=["rec", "i"]).withColumn("seg", F.lit(g))
        old_windows = t if old_windows is None else old_windows.unionByName(t)
    old_windows = cut(old_windows) if old_windows is not None else None
    # in how many records each window is
    seen = mine.select("h", "rec").distinct()
    seen = seen if old_windows is None else seen.unionByName(old_windows.select("h", "rec").distinct())
    weight = cut(seen.groupBy("h").agg(F.count(F.lit(1)).alias("w")).where("w > 1"))
    weighed = fragment_replicate_join(asked.select("rec", "n", "i", "h"), weight, ["h"], "left", loads=weight.select("h", F.col("w").alias("load")), spread_by=["rec", "i"])
    chosen = weighed.groupBy("rec", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("w", F.lit(1)).alias("w")))), lambda x: x["w"]).alias("ws"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def choose(ws: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([probes_of(w, k, share, size) for w, k in zip(ws, n)])

    probed = chosen.select("rec", "ws", F.explode(choose("ws", "n")).alias("i")).select("rec", "i", F.element_at("ws", F.col("i") + 1).alias("w"))
    probed = probed.join(asking.select("rec", F.col("last.o0").alias("batch"), "words", "hs"), "rec")
    probes = cut(probed.select("rec", "batch", "w", F.element_at("hs", F.col("i") + 1).alias("h"), F.array_join(F.slice("words", F.col("i") + 1, size), " ").alias("suffix")))
    salts = F.ceil(F.col("w") / PER_WINDOW).cast("int")
    wanted = cut(probes.groupBy("h").agg(F.max(salts).alias("salts")))
    shards = _shards(spark, probes.count())
    shard = F.pmod(F.hash("h", "salt"), F.lit(shards)).alias("shard")
    ask = probes.withColumn("salt", F.pmod(F.xxhash64("rec"), salts).cast("int"))
    kept = lookup_join(mine, wanted, ["h"], spread_by=["rec", "i"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    parts = [
        ask.select(shard, F.lit(1).alias("kind"), F.lit(0).alias("seg"), "batch", "rec", "suffix", F.lit(1).cast("bigint").alias("n")),
        kept.select(shard, F.lit(1).alias("kind"), F.lit(0).alias("seg"), "batch", "rec", "suffix", F.lit(0).cast("bigint").alias("n")),
    ]
    if old_windows is not None:
        stored = lookup_join(old_windows, wanted, ["h"], spread_by=["rec", "i"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        parts.append(stored.select(shard, F.lit(0).alias("kind"), "seg", F.lit(None).cast(parts[0].schema["batch"].dataType).alias("batch"), "rec", "suffix", F.lit(0).cast("bigint").alias("n")))
    sent = parts[0]
    for p in parts[1:]:
        sent = sent.unionByName(p)
    sent = sent.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "seg", "batch", "suffix", "n")
    pair = T.StructType([T.StructField("q", id_type), T.StructField("t", id_type)])

    def work(shard_rows: Iterator[tuple]) -> Iterator[tuple]:
        history = History()
        for (kind, _, _), group in _grouped(shard_rows):
            entries = [(s + END, r) for r, s, n in group if n == 0]
            if kind == 0:
                history.segments.append(Segment.of(entries))
                continue
            if entries:
                history.add(Segment.of(entries))
            for rec, s, n in group:
                if n:
                    for t in {r for r, _ in history.matches(s + END, len(s) + 1)}:
                        if t != rec:
                            yield rec, t

    found = sent.mapInArrow(_by_shard(work, pair), pair).repartition("q").distinct()
    texts = new.select("rec", "o", "hs")
    for t in known:
        texts = texts.unionByName(t.select("rec", "hs").withColumn("o", F.lit(None).cast(new.schema["o"].dataType)))  # stored ones come first
    a = found.join(asking.select(F.col("rec").alias("q"), "last", F.size("words").alias("n"), F.col("hs").alias("qh")), "q")
    b = a.join(texts.select(F.col("rec").alias("t"), F.col("o").alias("to"), F.col("hs").alias("th")), "t")
    b = b.where(F.col("to").isNull() | (F.col("to") < F.col("last"))).select("q", "t", "n", "to", "qh", "th")
    counted = T.StructType([*pair.fields, T.StructField("n", T.IntegerType()), T.StructField("to", new.schema["o"].dataType), T.StructField("c", T.LongType())])

    def compare(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([*x.columns[:4], pa.array(covered_words(x.column(4), x.column(5), size), pa.int64())], names=counted.names)

    c = F.least("c", "n")  # the one window of a short text counts as many words as it has
    pairs = b.mapInArrow(compare, counted).where(c >= F.col("n") * share - 1e-9).select("q", "t", "to", F.round(c / F.col("n"), 6).alias("coverage"))
    if each:
        pairs = _of_each_row(rows, asking, pairs)
    else:
        pairs = pairs.select(F.col("q").alias("id"), F.col("t").alias("stored_id"), "coverage")
        pairs = fold(pairs) if fold else pairs
    if store:
        pairs = cut(pairs)  # before the store changes
        store.add("windows", mine.select("h", "suffix", "rec", "i").repartition("h").sortWithinPartitions("suffix"), sort=("h", "suffix"))
        store.add("texts", new.select("rec", "o", "text", "words", "hs"))
    return pairs


def _of_each_row(rows: DataFrame, asking: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, stored_id, coverage, links) of each row, given its text's pairs (q, t, to, coverage), whatever row's order they hold for.

    Rows of a text are spread by their number, so a text of very many rows takes several tasks, each with the text's pairs.
    """
    loads = asking.select("text", "load")
    members = fragment_replicate_join(rows, asking.select("text", F.col("rec").alias("q")), ["text"], loads=loads, spread_by=["id"]).select("q", "id", "at")
    own = asking.where("load > 1 OR o IS NULL").select(F.col("rec").alias("q"), F.col("rec").alias("t"), F.col("o").alias("to"), F.lit(1.0).alias("coverage"))
    links = fragment_replicate_join(members, pairs.unionByName(own), ["q"], loads=asking.select(F.col("rec").alias("q"), "load"), keep_shard="shard", spread_by=["id"])
    links = links.where((F.col("to").isNull() | (F.col("to") < F.col("at"))) & (F.col("id") != F.col("t")))
    return links.select("id", F.col("t").alias("stored_id"), "coverage", F.count(F.lit(1)).over(Window.partitionBy("q", "shard", "id")).alias("links"))


def nearest(pairs: DataFrame) -> DataFrame:
    """(id, stored_id, coverage, links): one row per text, with the stored text that covers it best (of equal ones the least id), and how many do."""
    best = F.max_by(F.struct("stored_id", "coverage"), F.struct("coverage", -F.col("stored_id")))
    return pairs.groupBy("id").agg(best.alias("b"), F.count(F.lit(1)).alias("links")).select("id", "b.stored_id", "b.coverage", "links")
