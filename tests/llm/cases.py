"""Small tables that hold every awkward case, and brute-force forms of the operators."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, score string, row string, kept string"


def words(count: int, seed: int, vocabulary: int = 400) -> list[str]:
    pick = random.Random(seed)
    return [f"w{pick.randrange(vocabulary)}" for _ in range(count)]


def documents() -> list[tuple]:
    """Copies, near copies, a shared passage, a repeat inside one text, odd spaces, nulls and long texts."""
    base, other = words(120, 1), words(90, 2)
    passage = words(60, 3)
    near = base.copy()
    near[60] = "changed"
    far = base[:60] + words(60, 4)
    texts = {
        0: " ".join(base), 1: " ".join(base), 2: "  ".join(near), 3: " ".join(far).upper(),
        4: " ".join(other), 5: "\t".join(words(30, 5) + passage + words(20, 6)), 6: "\n".join(words(25, 7) + passage),
        7: " ".join(words(10, 8) + passage[:40] + words(5, 9) + passage[:40]),
        8: "", 9: None, 10: " \t\n ", 11: "one", 12: "one two", 13: "One  two", 14: "é ñ ü ß é ñ ü ß",
        15: " ".join(words(20000, 10, 5000)), 16: "same " * 80, 17: " ".join(words(20, 11)), 18: " ".join(base).replace("w", "W"),
    }
    rows = [(i, t) for i, t in texts.items()]
    rows += [(4, " ".join(other)), (None, " ".join(base)), (None, None), (20, "x" * 5000)]
    return [(i, t, None, None, None if t is None else len(t), "c", None, "r", "k") for i, t in rows]


def tokens(text: str | None, fold: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return (raw.lower() if fold else raw).split()


def shingles(text: str | None, size: int) -> frozenset:
    found = tokens(text, fold=True)
    if len(found) < size:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[k:k + size]) for k in range(len(found) - size + 1))


def groups(nodes, linked) -> dict:
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {n: top(n) for n in nodes}
