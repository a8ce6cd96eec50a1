from __future__ import annotations

import collections

import numpy as np
import pytest

from factloom.llm.encode import encode
from factloom.llm.mix import clean_targets, mix, pack, packed, permuted, shares_met, split_counts, token_counts


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 1000])
def test_permutation(n):
    assert sorted(permuted(np.arange(n), n, 7)) == list(range(n))
    if n > 9:
        assert list(permuted(np.arange(n), n, 7)) != list(permuted(np.arange(n), n, 8))


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, f"document number {i} " * (5 + i % 40), " Big" if i % 2 else "BIG ") for i in range(300)]
    docs += [(1000 + i, "small text of words " * 30, "small") for i in range(6)] + [(2000, None, "small"), (2001, "", "big"), (2002, "no target " * 50, "other"), (2003, "lost", None)]
    targets = [("big", 0.7, 3), ("Small", 0.3, 2), ("absent", 0.0001, 9)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_capacity(tables):
    docs, targets = tables
    c = {r["source"]: r for r in packed(docs, targets, block=64)[1].collect()}
    tokens = collections.Counter()
    sizes = {r["doc_id"]: r["n_tokens"] for r in encode(docs, "doc_id", "text", counts_only=True).collect()}
    for r in docs.collect():
        tokens[(r["source"] or "").strip().lower()] += sizes[r["doc_id"]]
    assert c["big"]["tokens"] == tokens["big"] and c["Small"]["tokens"] == tokens["small"]
    assert c["big"]["total"] == tokens["big"] + tokens["small"]
    assert c["big"]["reachable"] and not c["Small"]["reachable"] and not c["absent"]["reachable"]


def test_pack_covers_every_token_once(tables):
    docs, targets = tables
    counts = token_counts(docs)
    pieces, sizes = pack(counts, clean_targets(targets), 64)
    by_doc, by_block = collections.defaultdict(list), collections.Counter()
    for r in pieces.collect():
        by_doc[r["doc_id"]].append((r["start"], r["end"]))
        by_block[r["key"], r["block"]] += r["end"] - r["start"]
    want = {r["doc_id"]: r["n_tokens"] for r in counts.collect() if r["key"] in ("big", "small") and r["n_tokens"]}
    assert set(by_doc) == set(want)
    for d, spans in by_doc.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == want[d] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    n = {r["key"]: r["blocks"] for r in sizes.collect()}
    assert all(x <= 64 for x in by_block.values()) and collections.Counter(k for k, _ in by_block) == n


def test_mixture(tables):
    docs, targets = tables
    m, report = mix(docs, targets, size=40_000, block=64)
    r = {x["source"]: x for x in report.collect()}
    assert r["Small"]["repeats"] <= 2 and r["big"]["repeats"] <= 3 and r["absent"]["drawn"] == 0
    assert abs(r["big"]["share"] + r["Small"]["share"] - 1) < 1e-9
    drawn = collections.Counter()
    for x in m.collect():
        drawn[x["source"]] += x["end"] - x["start"]
    assert dict(drawn) == {k: v["drawn"] for k, v in r.items() if v["drawn"]}
    assert r["Small"]["share"] < 0.3 and r["Small"]["repeats"] == 2  # it runs out after two repeats; the other one takes its place
    assert abs(sum(drawn.values()) - min(40_000, 3 * r["big"]["tokens"] + 2 * r["Small"]["tokens"])) <= 128
    wide, report = mix(docs, targets, size=4_000, block=8)  # both can take their shares of this much
    s = {x["source"]: x for x in report.collect()}
    assert abs(s["big"]["share"] - 0.7) < 0.005 and abs(s["Small"]["share"] - 0.3) < 0.005 and abs(s["big"]["error"]) < 0.005


def test_shares_met():
    met = lambda s, m: [round(x, 6) for x in shares_met(np.array(s), np.array(m))]
    assert met([0.5, 0.3, 0.2], [9, 9, 9]) == [0.5, 0.3, 0.2]
    assert met([0.5, 0.3, 0.2], [9, 9, 0.1]) == [0.5625, 0.3375, 0.1]
    assert met([0.5, 0.3, 0.2], [0.52, 9, 0.1]) == [0.52, 0.38, 0.1]
    assert met([0.5, 0.5], [0.1, 0.2]) == [0.1, 0.2] and met([0.3, 0.3], [9, 0.1]) == [0.5, 0.1] and met([1, 1], [9, 9]) == [0.5, 0.5]


@pytest.mark.parametrize("slots,per,counts", [(1000, 64, [700, 250, 50]), (1000, 64, [10, 0, 3]), (5, 64, [5]), (129, 64, [64, 65])])
def test_counts_of_all_shards_add_up(slots, per, counts):
    shards = -(-slots // per)
    drawn = [split_counts(s, shards, per, slots, np.array(counts)) for s in range(shards)]
    assert list(sum(drawn)) == counts
    assert all(0 <= x.sum() <= min(per, slots - s * per) and (x >= 0).all() for s, x in enumerate(drawn))


def test_unreachable_sources_by_hand(tables):
    """Beside p8_found's operator: tokens counted by the tokenizer itself, text by text."""
    from factloom.llm.encode import encoder, vocabulary_path

    docs, targets = tables
    e, tokens = encoder(vocabulary_path()), collections.Counter()
    for r in docs.collect():
        tokens[(r["source"] or "").strip().lower()] += len(e.direct(r["text"] or ""))
    t = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.collect()]
    total = sum(tokens[s.lower()] for s, _, _ in t)
    want = {s for s, share, cap in t if cap * tokens[s.lower()] < share * total}
    assert {r["source"] for r in packed(docs, targets)[1].where("NOT reachable").collect()} == want == {"Small", "absent"}


def test_empty(spark, tables):
    docs, targets = tables
    m, report = mix(docs.limit(0), targets)
    assert m.count() == 0 and {x["drawn"] for x in report.collect()} == {0}
    assert clean_targets(targets.limit(0)).count() == 0
