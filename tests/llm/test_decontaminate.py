"""Spaced seeds against comparing every alignment."""

import itertools
import random

import pytest
from cases import documents, tokens, words

from tendero.llm.decontaminate import MASKS, OVERLAP, SUBSTITUTED, benchmark_overlaps, decontaminated


def test_masks_hit_every_pattern_of_substitutions():
    for wrong in itertools.combinations(range(OVERLAP), SUBSTITUTED):
        assert any(all(start + k not in wrong for k in mask) for mask in MASKS for start in range(OVERLAP - mask[-1]))


def tables():
    pick = random.Random(8)
    items = [words(pick.randrange(13, 50), 100 + k, 3000) for k in range(30)] + [["short"] * 3, []]
    docs = []
    for k in range(120):
        text = words(80, 500 + k, 3000)
        item = items[k % 30]
        part = item[: pick.choice([len(item), 13, 16, 12])] if k % 3 else item
        part = part.copy()
        for _ in range(k % 5):
            part[pick.randrange(len(part))] = "other"
        if k % 4:
            text[20:20] = part
        docs.append((k, " ".join(text).upper() if k % 2 else "\t".join(text)))
    docs += [(i, t) for i, t, *_ in documents()]
    return docs, [(1000 + k, " ".join(t)) for k, t in enumerate(items)] + [(None, " ".join(items[0])), (None, None), (1, " ".join(items[1]))]


def holds(text, item):
    for offset in range(OVERLAP - len(item), len(text) - OVERLAP + 1):
        low, high = max(0, -offset), min(len(item), len(text) - offset)
        same = [text[offset + k] == item[k] for k in range(low, high)]
        if any(sum(same[s:s + OVERLAP]) >= OVERLAP - SUBSTITUTED for s in range(len(same) - OVERLAP + 1)):
            return True
    return False


@pytest.mark.parametrize("bytes_", [0, 1 << 20])
def test_overlaps_are_those_of_every_alignment(spark, monkeypatch, bytes_):
    monkeypatch.setattr("tendero.llm.decontaminate.BROADCAST_BYTES", bytes_)
    docs, items = tables()
    wanted = []
    for i, text in docs:
        found = [(tuple(tokens(v, True)), j) for j, v in items if holds(tokens(text, True), tokens(v, True))]
        wanted.append(str((i, bool(found), len({f[0] for f in found}), min((f[1] for f in found if f[1] is not None), default=None))))
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item long, seed string")
    bench = spark.createDataFrame([(*b, 1) for b in items], "item_id long, text string, doc_id int")
    assert sorted(str(tuple(r)) for r in benchmark_overlaps(frame, bench).collect()) == sorted(wanted)
    clean = decontaminated(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d[0]) for d, w in zip(docs, wanted) if ", False, " in w)


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_overlaps(no_docs, none).collect() == []
    assert benchmark_overlaps(docs, none).where("contaminated").count() == 0 and decontaminated(docs, none).count() == docs.count()
