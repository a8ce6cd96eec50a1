"""Mixing sources to target weights of tokens, with capped repeats.

Tokens of each source are packed into blocks of fixed length; each output shard draws multinomial
counts of sources, given that all shards together take what the plan gives each source; slots go through
pseudorandom permutations of each source's block numbers, one per repeat; and the blocks are joined by number.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.cleaning import strip_blank
from factloom.llm.encode import encode
from factloom.operators.skew import lookup_join
from factloom.session import cut

#: Tokens of a block; slots of an output shard; tokens of a packing bucket.
BLOCK, SHARD_SLOTS, BUCKET_TOKENS = 512, 1_024, 4_000_000
#: Neither shards nor a source's buckets get more than this; beyond it they get larger.
MOST_PARTS = 100_000
#: Sources with a target; every shard draws a count for each.
MOST_SOURCES = 10_000
SEED = 20_240


def source_key(c):
    return F.lower(strip_blank(c))


def clean_targets(targets: DataFrame) -> DataFrame:
    """(key, source, share, cap) of each target; of several spellings of one source the first counts."""
    return (
        targets.where(F.col("source").isNotNull() & F.col("target_share").isNotNull())
        .groupBy(source_key(F.col("source")).alias("key"))
        .agg(F.min(F.struct("source", "target_share", "max_repeats")).alias("t"))
        .select("key", "t.source", F.col("t.target_share").cast("double").alias("share"), F.greatest(F.coalesce("t.max_repeats", F.lit(1)), F.lit(0)).cast("bigint").alias("cap"))
    )


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(key, doc_id, n_tokens) of every document; the source cleaned."""
    src = documents.select("doc_id", source_key(F.col("source")).alias("key"), "text")
    return encode(src, "doc_id", "text", path, counts_only=True, carry=["key"])


def capacity(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: tokens and blocks (from the sizes that pack() gives), total of all target sources, cap, share, and whether the share can be reached.

    A source can't reach its share if cap * tokens < share * total.  Sources without documents have 0 tokens.
    """
    out = clean_targets(targets).join(packed, "key", "left").fillna(0, ["tokens", "blocks"])
    out = out.withColumn("total", F.sum("tokens").over(W.partitionBy()).cast("bigint"))  # a row per source
    return out.withColumn("reachable", F.col("cap") * F.col("tokens") >= F.col("share") * F.col("total"))


def pack(counts: DataFrame, keys: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pieces, sizes): pieces (key, block, doc_id, start, end) cover every token of every document of the keys once.

    Documents of a source are spread over buckets by a hash and laid end to end in each; a bucket's last
    block may be short.  sizes: (key, blocks, tokens), counted over what was laid.  A document that is there
    several times is laid each time.
    """
    mine = lookup_join(counts, keys.select("key").distinct(), ["key"], "left_semi", spread_by=["doc_id"])
    totals = mine.groupBy("key").agg(F.sum("n_tokens").alias("tokens"))
    nb = F.greatest(F.lit(1), F.least(F.lit(MOST_PARTS), F.ceil(F.col("tokens") / BUCKET_TOKENS))).cast("bigint")
    placed = lookup_join(mine.where("n_tokens > 0"), totals.select("key", nb.alias("nb")), ["key"], spread_by=["doc_id"])
    placed = placed.withColumn("h", F.xxhash64("doc_id", F.lit(SEED))).withColumn("bucket", F.pmod("h", "nb"))
    w = W.partitionBy("key", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    laid = placed.withColumn("to", F.sum("n_tokens").over(w)).withColumn("from", F.col("to") - F.col("n_tokens"))
    laid = cut(laid.select("key", "bucket", "doc_id", "from", "to"))
    buckets = laid.groupBy("key", "bucket").agg(F.ceil(F.max("to") / block).alias("b"), F.max("to").alias("size"))
    first = F.sum("b").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("b")
    base = cut(buckets.withColumn("base", first))
    sizes = base.groupBy("key").agg(F.sum("b").cast("bigint").alias("blocks"), F.sum("size").cast("bigint").alias("tokens"))
    laid = lookup_join(laid, base.select("key", "bucket", "base"), ["key", "bucket"], spread_by=["doc_id"])
    low, high = F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)
    pieces = laid.select("key", "doc_id", "from", "to", "base", F.explode(F.sequence(low, high)).alias("i")).select(
        "key",
        (F.col("base") + F.col("i")).alias("block"),
        "doc_id",
        (F.greatest(F.col("from"), F.col("i") * block) - F.col("from")).alias("start"),
        (F.least(F.col("to"), (F.col("i") + 1) * block) - F.col("from")).alias("end"),
    )
    return pieces, sizes


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 (a Feistel network, walked until inside the range)."""
    half = max(1, (max(1, int(n - 1).bit_length()) + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            with np.errstate(over="ignore"):
                z = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                z ^= z >> np.uint64(29)
                z *= np.uint64(0x94D049BB133111EB)
                z ^= z >> np.uint64(32)
            left, right = right, left ^ (z & mask)
        return (left << np.uint64(half)) | right

    x = once(i.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def shares_met(shares: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Shares with what some can't reach (most) given to the others, in proportion to their shares, as far as they can take it.

    Shares that sum to more than 1 are scaled to it; what they lack of 1 is given to none.
    """
    want = np.maximum(shares, 0.0) / max(1.0, np.maximum(shares, 0.0).sum())
    whole, out, open_ = want.sum(), want.copy(), want > 0
    while True:
        over = open_ & (out > most)
        if not over.any():
            return out
        out[over], open_ = most[over], open_ & ~over
        if not want[open_].sum():
            return out
        out[open_] = want[open_] * (whole - out[~open_].sum()) / want[open_].sum()


def split_counts(shard: int, shards: int, per: int, slots: int, counts: np.ndarray) -> np.ndarray:
    """How many slots of a shard each source gets, drawn so that all shards together have `counts`.

    Multinomial draws given their totals: shards are halved again and again, and each half's counts are a draw without
    replacement from its parent's, by a generator of the half's own.  So shards can be drawn alone, in any task.
    """
    low, high, have = 0, shards, counts
    size = lambda a, b: min(b * per, slots) - min(a * per, slots)
    while high - low > 1:
        mid = (low + high) // 2
        n, left = int(have.sum()), size(low, mid)
        # empty slots, if the counts don't fill all, are one more source
        space = np.append(have, size(low, high) - n)
        first = np.random.default_rng([SEED, low, high]).multivariate_hypergeometric(space, left, method="marginals")[:-1]
        low, high, have = (low, mid, first) if shard < mid else (mid, high, have - first)
    return have


def planned(plan: DataFrame, slots: int) -> list[tuple[str, int, int, float]]:
    """(key, slots, blocks, share) of each source with blocks: whole slots by the shares that can be met.  plan: key, share, cap, blocks, tokens.

    A source's blocks hold tokens / blocks tokens on average, so one with short blocks gets more slots.
    """
    rows = sorted((r["key"], r["share"], r["cap"], r["blocks"], r["tokens"]) for r in plan.where("blocks > 0").limit(MOST_SOURCES + 1).collect())
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not rows or not slots:
        return []
    share, cap, blocks, tokens = (np.array([r[i] for r in rows], float) for i in (1, 2, 3, 4))
    mean = tokens / blocks
    size = slots * BLOCK if not tokens.sum() else slots * (tokens.sum() / blocks.sum())
    met = shares_met(share, cap * tokens / size)
    exact = np.minimum(met * size / mean, cap * blocks)
    n = np.floor(exact).astype(np.int64)
    rest = min(int(round(exact.sum())) - int(n.sum()), len(n))
    order = np.argsort(-(exact - n), kind="stable")
    for i in [i for i in order if n[i] < cap[i] * blocks[i]][: max(0, rest)]:  # the largest remainders
        n[i] += 1
    return [(r[0], int(k), int(r[3]), float(m)) for r, k, m in zip(rows, n, met)]


def draw(spark, rows: list[tuple[str, int, int, float]], slots: int) -> DataFrame:
    """(shard, key, block, epoch) of each output slot.  rows: as of planned().

    The i-th slot of a source takes the block that the permutation of repeat i // blocks has at i % blocks, so no
    block is drawn more often than there are whole repeats, and all of them once before any twice.
    """
    total = sum(n for _, n, _, _ in rows)
    slots = max(slots, total)
    per = max(SHARD_SLOTS, -(-slots // MOST_PARTS))
    shards = max(1, -(-slots // per))
    counts = np.array([n for _, n, _, _ in rows], dtype=np.int64)

    def drawn(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            out = [split_counts(s, shards, per, slots, counts) for s in ids] if len(rows) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, len(rows)), pa.int64()), pa.array(list(range(len(rows))) * len(ids), pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int64())],
                names=["shard", "k", "n"],
            )

    tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    table = cut(spark.range(0, shards, 1, tasks).mapInArrow(drawn, "shard long, k int, n long").where("n > 0"))
    before = F.sum("n").over(W.partitionBy("k").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")

    def fill(batches):
        for b in batches:
            for s, k, n, at in zip(*(c.to_pylist() for c in b.columns)):
                key, _, blocks, _ = rows[k]
                g = np.arange(at, at + n, dtype=np.int64)
                for e in np.unique(g // blocks):
                    i = g[g // blocks == e] % blocks
                    m = len(i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, s)), pa.array([key] * m, pa.string()), pa.array(permuted(i, blocks, crc32(f"{key}/{e}/{SEED}".encode()))), pa.array(np.full(m, e))],
                        names=["shard", "key", "block", "epoch"],
                    )

    spread = table.withColumn("at", before).repartition(tasks, "shard", "k")
    return spread.mapInArrow(fill, "shard long, key string, block long, epoch long")


def packed(documents: DataFrame, targets: DataFrame, path: str | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pieces, plan): every token of the target sources in blocks, and each source's capacity()."""
    pieces, sizes = pack(cut(token_counts(documents, path)), clean_targets(targets), block)
    return pieces, cut(capacity(sizes, targets))


def mix(documents: DataFrame, targets: DataFrame, path: str | None = None, size: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(mixture, report) of about `size` tokens (all target sources' tokens, if not given).

    mixture: (shard, source, block, epoch, doc_id, start, end), token ranges of documents.
    report: (source, target_share, planned_share, tokens, reachable, drawn, share, error, repeats).  What sources can't
    reach is given to those that can take it, in proportion to their targets: planned_share is each
    one's share after that, share the one reached among all drawn tokens, error what it is off.  Errors come from
    whole slots only (under one block a source, and as much again for short last blocks).
    Null and empty texts have no tokens; sources without a target take no part.  No block, so no token, is
    drawn more than max_repeats times.
    """
    spark = documents.sparkSession
    pieces, plan = packed(documents, targets, path, block)
    total = plan.agg(F.max("total")).first()[0] or 0
    wanted = -(-(size or total) // block)
    rows = planned(plan.select("key", "share", "cap", "blocks", "tokens"), wanted)
    met = spark.createDataFrame([(k, m) for k, _, _, m in rows], "key string, met double")
    slots = cut(draw(spark, rows, wanted))
    lengths = pieces.groupBy("key", "block").agg(F.sum(F.col("end") - F.col("start")).alias("len"))
    used = slots.groupBy("key", "block").agg(F.count(F.lit(1)).alias("times"))
    got = used.join(lengths, ["key", "block"]).groupBy("key").agg(F.sum(F.col("times") * F.col("len")).alias("drawn"), F.max("times").alias("repeats"))
    report = plan.join(got, "key", "left").join(F.broadcast(met), "key", "left").select(  # a row per source
        "source", F.col("share").alias("target_share"), F.coalesce("met", F.lit(0.0)).alias("met"), "tokens", "reachable", F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce("repeats", F.lit(0)).alias("repeats")
    )
    of = lambda c: F.when(F.sum(c).over(W.partitionBy()) > 0, F.col(c) / F.sum(c).over(W.partitionBy())).otherwise(F.lit(0.0))  # noqa: E731 - one row per source
    report = report.withColumn("planned_share", of("met")).withColumn("share", of("drawn")).withColumn("error", F.col("share") - F.col("planned_share")).drop("met")
    mixture = slots.join(pieces, ["key", "block"])
    return lookup_join(mixture, plan.select("key", "source"), ["key"], spread_by=["shard", "block", "epoch", "doc_id", "start"]).drop("key"), report
