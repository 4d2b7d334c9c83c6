"""Near vectors against all cosines."""

import math

import numpy as np
import pytest
from cases import groups

from tendero.llm.embedding import near_vectors


def vectors():
    random = np.random.default_rng(3)
    rows = []
    for k in range(60):
        center = random.standard_normal(16)
        for _ in range(4):
            rows.append([float(x) for x in center + random.standard_normal(16) * random.choice([0.02, 0.1, 0.2])])
    rows += [rows[0], [2 * x for x in rows[1]]]
    return list(enumerate(rows))


def test_links_are_exact_and_nearly_all_found(spark):
    rows = vectors()
    odd = [(900, None), (901, [0.0] * 16), (902, [1.0, None] * 8), (903, [math.nan] * 16), (904, []), (905, [math.inf] + [0.0] * 15), (None, rows[0][1]), (906, [1.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, label int, rep string")
    found = near_vectors(table, 0.95).collect()
    assert len(found) == len(rows) + len(odd)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    by_id = {r["vec_id"]: r for r in found}
    assert all(by_id[i]["n_links"] <= linked[i].sum() for i, _ in rows)
    assert sum(by_id[i]["n_links"] for i, _ in rows) >= 0.97 * linked.sum()
    components = groups(range(len(rows)), lambda a, b: linked[a, b])
    assert sum(by_id[i]["component_id"] == components[i] for i in components) >= 0.97 * len(rows)
    for i, _ in odd:
        if i is not None:
            assert (by_id[i]["n_links"], by_id[i]["component_id"], by_id[i]["kept"]) == (0, i, True)
    assert (by_id[None]["n_links"], by_id[None]["component_id"], by_id[None]["kept"]) == (0, None, False)


@pytest.mark.parametrize("block", [1024, 16])
def test_a_large_group_is_linked_whole(spark, monkeypatch, block):
    monkeypatch.setattr("tendero.llm.embedding.BLOCK", block)
    random = np.random.default_rng(5)
    center = random.standard_normal(32)
    rows = [(k, [float(v) for v in center + 0.03 * random.standard_normal(32)]) for k in range(80)]
    rows += [(100 + k, rows[0][1]) for k in range(20)]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95).collect()
    assert {r["component_id"] for r in found} == {0}
    assert {r["n_links"] for r in found} == {99}


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
