"""The prefix trie against a dictionary of prefixes."""

import random
from collections import defaultdict
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from tendero.llm.prefix_trie import _two_fattest, prefix_trie, turn_lists

SCHEMA = "conv_id long, turn long, role string, text string, host long, m string, prefix string"


def expected(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, key, role, text))
    lists = {c: tuple(t[3:] for t in sorted(ts)) for c, ts in turns.items()}
    members = defaultdict(list)
    for conv, own in lists.items():
        for d in range(len(own) + 1):
            members[own[:d]].append(conv)
    below = defaultdict(lambda: [0, 0])
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, convs in members.items():
        saved = (len(convs) - 1) * (len(node[-1][1].encode()) if node else 0)
        for d in range(len(node) + 1):
            below[node[:d]][0] += not kids[node]
            below[node[:d]][1] += saved
    made = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(lists[c]) == len(node))))
        made.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), kids[node], *below[node], sha256(ends.encode()).hexdigest()))
    return sorted(made, key=str)


def conversation(conv, texts):
    return [(conv, k, "user" if k % 2 else "bot", t) for k, t in enumerate(texts)]


def branching(count, seed):
    pick = random.Random(seed)
    rows = []
    for conv in pick.sample(range(-1000, 5000), count):
        rows += conversation(conv, [pick.choice("abé") * pick.randrange(1, 3) for _ in range(pick.randrange(1, 12))])
    return rows


CASES = {
    "branching": branching(150, 1),
    "one conversation": conversation(5, ["a", "b"]),
    "each a prefix of the next": [r for c in range(60) for r in conversation(c, [f"t{k}" for k in range(c + 1)])],
    "each a prefix of the one before": [r for c in range(40) for r in conversation(c, [f"t{k}" for k in range(40 - c)])],
    "one long among copies": [r for c in range(50) for r in conversation(c, ["a", "b", "c"])] + conversation(99, ["a", "b"] + ["x"] * 700),
    "all leave one path": [r for c in range(64) for r in conversation(c, [f"t{k}" for k in range(c)] + [f"own {c}"])],
    "nulls, ties and odd rows": [(1, None, None, None), (1, None, "", ""), (1, 3, "u", "b"), (1, 3, "u", "a"), (2, None, None, ""), (2, 5, None, None), (3, 0, "x", None), (None, 1, "u", "lost"),
                                 (4, 1, "u", "z" * 100000), (5, 1, "u", "z" * 100000), (4, 1, "u", "z" * 100000), (-6, 2, "us", "er"), (7, 2, "use", "r")],
}


@pytest.mark.parametrize("case", CASES)
def test_trie_is_that_of_prefixes(case, spark):
    given = CASES[case]
    df = spark.createDataFrame([(*r, None, "m", "p") for r in given], SCHEMA).repartition(3)
    assert sorted(map(tuple, prefix_trie(turn_lists(df)).collect()), key=str) == expected(given)


def test_turnless_conversations_end_at_the_root(spark):
    lists = turn_lists(spark.createDataFrame(conversation(3, ["a"]) + conversation(8, ["b"]) + conversation(12, ["b"]), "conv_id long, turn long, role string, text string"))
    some = lists.withColumn("turns", F.when(F.col("conv_id") == 3, F.slice("turns", 1, 0)).otherwise(F.col("turns")))
    ends = {n: sha256(n.encode()).hexdigest() for n in ("3", "8,12")}
    assert sorted(map(tuple, prefix_trie(some).collect())) == [(3, 0, None, 3, 1, 1, 1, ends["3"]), (8, 1, 3, 2, 0, 1, 1, ends["8,12"])]
    none = lists.withColumn("turns", F.slice("turns", 1, 0))
    assert [tuple(r)[:7] for r in prefix_trie(none).collect()] == [(3, 0, None, 3, 0, 1, 0)]


def test_no_conversations(spark):
    assert prefix_trie(turn_lists(spark.createDataFrame([], SCHEMA))).collect() == []


def test_two_fattest_depths(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    found = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.expr(_two_fattest("a", "b"))).collect()
    assert all(f == max(range(a + 1, b + 1), key=lambda d: (d & -d, -d)) for a, b, f in found)
