"""Packing: nothing lost, nothing too long, and close to the best."""

import itertools
import random

import pytest
from cases import documents, tokens

from tendero.llm import packing
from tendero.llm.packing import best_fit, cost, pack, word_lengths


def least_cost(sizes, capacities):
    """The cheapest packing, by trying all ways to group."""
    best = float("inf")

    def place(k, bins):
        nonlocal best
        if k == len(sizes):
            best = min(best, sum(cost(min(c for c in capacities if c >= b)) for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacities[-1]:
                place(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1:])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_best_fit_is_near_the_best():
    pick = random.Random(6)
    ratios = []
    for _ in range(60):
        sizes = sorted((pick.randrange(1, 8192) for _ in range(7)), reverse=True)
        capacities = (2048, 4096, 8192)
        place, bins = best_fit(sizes, capacities)
        held = [sum(s for s, p in zip(sizes, place) if p == b) for b in range(len(bins))]
        assert all(h <= c for h, c in zip(held, bins)) and all(c == min(x for x in capacities if x >= h) for h, c in zip(held, bins))
        ratios.append(sum(map(cost, bins)) / least_cost(sizes, capacities))
    assert max(ratios) <= 1.5 and sum(ratios) / len(ratios) <= 1.06


def test_equal_sizes_fill_bins():
    place, bins = best_fit([1024] * 16, (1024, 2048, 4096, 8192))
    assert bins == [8192, 8192] and sorted(place) == [0] * 8 + [1] * 8


@pytest.mark.parametrize(("capacities", "block"), [((64, 128, 256), 16384), ((50, 100), 5), ((1024, 2048, 4096, 8192), 16384)])
def test_every_word_is_placed_once(docs, monkeypatch, capacities, block):
    monkeypatch.setattr("tendero.llm.packing.BLOCK_PIECES", block)
    rows = pack(word_lengths(docs), capacities).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["row"]), set()).add((r["piece"], r["start"], r["n_tokens"]))
    wanted = {}
    for i, text, *_ in documents():
        wanted.setdefault(i, set()).add(len(tokens(text)) + 1)
    for (i, _), pieces in by_doc.items():
        pieces = sorted(pieces)
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert [p[1] for p in pieces] == [0, *itertools.accumulate(p[2] for p in pieces)][:-1]
        assert sum(p[2] for p in pieces) in wanted[i]
    assert sum(r["n_tokens"] for r in rows) == sum(len(tokens(t)) + 1 for _, t, *_ in documents())
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append((r["offset"], r["n_tokens"], r["capacity"]))
    for held in bins.values():
        held.sort()
        assert [h[0] for h in held] == [0, *itertools.accumulate(h[1] for h in held)][:-1]
        assert {h[2] for h in held} == {min(c for c in capacities if c >= sum(h[1] for h in held))}


def test_empty_and_null_lengths(spark, no_docs):
    assert pack(word_lengths(no_docs)).collect() == []
    odd = spark.createDataFrame([(1, 1, None), (2, 2, 0), (3, 3, -1)], "doc_id long, row long, n_tokens long")
    assert pack(odd).collect() == []


def test_rows_that_repeat_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 1024)
    lengths = spark.range(60000).selectExpr("if(id % 2 = 0, 5, id) AS doc_id", "if(id % 2 = 0, 1, id) AS row", "30L AS n_tokens").repartition(4)
    packed = packing.pack(lengths)
    blocks = packed.groupBy((packed["bin_id"].bitwiseAND(~((1 << 32) - 1))).alias("block")).count().collect()
    assert sum(r["count"] for r in blocks) == 60000 and max(r["count"] for r in blocks) < 2 * 1024
