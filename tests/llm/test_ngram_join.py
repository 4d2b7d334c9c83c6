"""The n-gram join against all pairs."""

import random

import numpy as np
import pytest
from cases import documents, groups, shingles

from tendero.llm import ngram_join
from tendero.llm.ngram_join import _signature, ngram_components, one_of_each
from tendero.llm.words import seeded


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_components_are_those_of_all_pairs(docs, size, percent):
    sets = {i: shingles(t, size) for i, t, *_ in documents() if i is not None}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return bool(sets[a]) and bool(sets[b]) and 100 * both >= percent * len(sets[a] | sets[b])

    expected = groups(sets, linked)
    rows = ngram_components(docs, size, percent).collect()
    assert len(rows) == len(documents())
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["component_id"], r["n_shingles"]) == (expected[r["doc_id"]], len(sets[r["doc_id"]]))


def test_many_near_copies_make_one_component(spark):
    base = [f"b{k}" for k in range(200)]
    rows = [(k, " ".join(base[:k] + ["own%d" % k] + base[k + 1:])) for k in range(150)]
    found = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r["component_id"] for r in found} == {0}


def test_a_chain_is_one_component(spark):
    line = [f"c{k}" for k in range(260)]
    rows = [(9 - k, " ".join(line[4 * k:4 * k + 200])) for k in range(10)]
    sets = {i: shingles(t, 3) for i, t in rows}
    expected = groups(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]))
    found = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected


def test_empty_table(no_docs):
    assert ngram_components(no_docs, 3, 90).collect() == []


def test_one_of_each_keeps_columns_and_rows_without_id(docs):
    kept = one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and {0, 4, 8, 9}.issubset(ids) and not {1, 2, 18}.intersection(ids)


def test_signatures_differ_in_no_more_bits_than_the_sets_in_shingles():
    pool = seeded(np.arange(4000, dtype=np.uint64), 77)
    draw = np.random.default_rng(5)
    for size in (1, 7, 60, 900, 4000):
        for _ in range(40):
            x, y = (draw.choice(pool, draw.integers(1, size + 1), replace=False) for _ in range(2))
            apart = len(np.setxor1d(x, y))
            bits = int(np.bitwise_count((_signature(x) ^ _signature(y)).view(np.uint64)).sum())
            assert bits <= apart and (bits - apart) % 2 == 0


def test_a_large_group_around_the_threshold_keeps_every_link(spark):
    """Members share most of one passage; some pairs reach 0.9, others stay just below."""
    draw = random.Random(3)
    base = [f"g{k}" for k in range(240)]
    rows = []
    for k in range(160):
        words = list(base)
        for at in draw.sample(range(240), draw.choice((1, 2, 3, 4, 5, 7))):
            words[at] = f"own{k}x{at}" if k % 3 else "x"
        rows.append((k, " ".join(words)))
    sets = {i: shingles(t, 3) for i, t in rows}
    alike = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b]
    assert min(alike) < 0.85 and sum(0.85 < x < 0.95 for x in alike) > 1000
    expected = groups(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]))
    found = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected


def test_postings_are_summed_up_without_sorting_them(spark, monkeypatch):
    """No step on all postings sorts them for an aggregate, as rows in its buffer would ask for."""
    plans, real = {}, ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().toString()) and real(df, label))
    line = [f"v{k}" for k in range(40)]
    rows = [(k, " ".join([*line, f"own{k}"])) for k in range(6)]
    found = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r["component_id"] for r in found} == {0}
    for label in ("postings", "pairs", "placed"):
        assert "HashAggregate" in plans[label] and "SortAggregate" not in plans[label]
