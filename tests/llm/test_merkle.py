"""Manifests against trees built list by list."""

import random
from hashlib import sha256

import pytest

from tendero.llm import merkle
from tendero.llm.merkle import folded, leaf_of, manifest, ranked

ROWS = "grp string, id long, leaf binary, claimed binary, rank string, word long, n long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The levels of a tree, from the leaves up."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k:k + 2]) for k in range(0, len(last), 2)])
    return levels


def siblings(levels, pos):
    found = []
    for level in levels[:-1]:
        if pos ^ 1 < len(level):
            found.append((level[pos ^ 1], pos & 1))
        else:
            found.append(None)
        pos >>= 1
    return found


def climb(digest, path):
    for step in path:
        digest = h(digest) if step is None else h(step[0], digest) if step[1] else h(digest, step[0])
    return digest


def expected(rows):
    groups = {}
    for grp, i, leaf, claimed in rows:
        groups.setdefault(grp, []).append((i is not None, i or 0, leaf.hex(), claimed))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    over = tree([trees[g][-1][0] for g in order])
    made = []
    for k, g in enumerate(order):
        for pos, (known, i, leaf, claimed) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = siblings(trees[g], pos) + siblings(over, k)
            root = climb(claimed.hex() if claimed else leaf, path)
            made.append((i if known else None, leaf, trees[g][-1][0], over[-1][0], h(*(s[0] for s in path if s)), root, root == over[-1][0]))
    return sorted(made, key=str)


def digest(x):
    return sha256(str(x).encode()).digest()


def rows(count, seed, groups=("en", "de", None, "", "é", "z"), spread=10**6):
    pick = random.Random(seed)
    ids = pick.sample(range(-spread, spread), count)
    return [(pick.choice(groups), i, digest(i), digest(-i) if i % 7 == 0 else None) for i in ids]


CASES = {
    "sparse ids of both signs": rows(700, 1),
    "far ids": [(None, i, digest(i), None) for i in (-2**63, 2**63 - 1, 0, 63, 64, -1, -64, 2**40)],
    "dense ids": [("a" if i % 3 else "b", i, digest(i), None) for i in range(1500)],
    "one leaf": [("a", 5, digest(5), None)],
    "one leaf, claimed otherwise": [("a", 5, digest(5), digest(6))],
    "many groups": [(f"g{i % 300}", i, digest(i), None) for i in range(900)],
    "ties and nulls": rows(200, 2, ("a", None), 150) + [("a", None, digest(k % 40), None) for k in range(90)] + [("a", 7, digest(k), digest(0)) for k in range(80)] + [(None, 7, digest(1), None)] * 30,
}


@pytest.mark.parametrize("case", CASES)
def test_manifest_is_that_of_lists(case, spark, monkeypatch):
    monkeypatch.setattr(merkle, "RUN", 8)
    given = CASES[case]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in given], ROWS).repartition(3).select("grp", "id", "leaf", "claimed")
    assert sorted(map(tuple, manifest(df).collect()), key=str) == expected(given)


def test_digests_that_agree_in_their_head(spark):
    given = [("a", 1, bytes(7) + digest(k)[:25], None) for k in range(20)]
    df = spark.createDataFrame(given, "grp string, id long, leaf binary, claimed binary")
    assert sorted(map(tuple, manifest(df).collect()), key=str) == expected(given)


def test_empty_table(spark):
    assert manifest(spark.createDataFrame([], "grp string, id long, leaf binary, claimed binary")).collect() == []


def test_ranks_read_several_directories(spark):
    ids = [0, 1, 63, 64, 2**14 - 1, 2**14, 2**22, 2**30 + 5, 2**40, -3, None]
    found = ranked(spark.createDataFrame([("g", i, 2) for i in ids], "grp string, id long, c long"), ["grp"], "id").collect()
    order = sorted(ids, key=lambda i: (i is not None, i or 0))
    assert {r["id"]: (r["rank"], r["here"]) for r in found} == {i: (2 * k, 2) for k, i in enumerate(order)}


def test_a_leaf_is_its_fields(spark):
    made = spark.createDataFrame([(1, None, "é", "")], "a long, b string, c string, d string")
    found = made.select(leaf_of([made[c] for c in "abcd"])).first()[0]
    assert bytes(found).hex() == h("1:1", "-", "2:é", "0:")


def test_a_proof_fails_for_another_leaf():
    leaves = [digest(k) for k in range(5)]
    levels = tree([x.hex() for x in leaves])
    for pos, leaf in enumerate(leaves):
        path = b"".join(bytes.fromhex(s[0]) for s in siblings(levels, pos) if s)
        assert folded(leaf, path, [(pos, 5)]).hex() == levels[-1][0] != folded(digest("x"), path, [(pos, 5)]).hex()
