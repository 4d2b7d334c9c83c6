"""Cut repeats against counting every window."""

from collections import Counter

import pytest
from cases import DOC_SCHEMA, documents, tokens, words

from tendero.llm import substring
from tendero.llm.substring import COVERS, cover_for, cut_repeats, without_repeats


def expected(rows, window):
    counts = Counter()
    for text in rows:
        found = tokens(text)
        counts.update(tuple(found[k:k + window]) for k in range(len(found) - window + 1))
    made = []
    for text in rows:
        found = tokens(text)
        gone = [False] * len(found)
        for k in range(len(found) - window + 1):
            if counts[tuple(found[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        made.append((len(found), sum(gone), b" ".join(w for w, g in zip(found, gone) if not g).decode()))
    return made


@pytest.mark.parametrize("window", [9, 35])
def test_cut_is_that_of_counting_windows(docs, window):
    rows = [(r[0], r[1]) for r in documents()]
    wanted = sorted((str(i), *e) for (i, _), e in zip(rows, expected([t for _, t in rows], window)))
    cut = cut_repeats(docs, window).select("rest.doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in cut) == wanted


def test_covers_hold_every_difference():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert cover_for(35)[0] == 21 and cover_for(5)[0] == 1


def test_empty_table(no_docs):
    assert cut_repeats(no_docs).collect() == []


def test_rows_keep_their_columns(docs):
    kept = without_repeats(docs, 35)
    assert kept.schema.names == docs.schema.names
    by_id = {r["doc_id"]: r for r in kept.collect()}
    assert by_id[17]["text"] == dict((r[0], r[1]) for r in documents())[17]
    assert by_id[5]["n_chars"] == len(by_id[5]["text"]) and by_id[1]["text"] == "" and by_id[9]["text"] is None and len(by_id) == len({r[0] for r in documents()})


def test_no_block_holds_the_rows_that_repeat(spark, monkeypatch):
    """A third each of equal rows, of empty texts and of null rows are dealt as one row or not at all."""
    monkeypatch.setattr(substring, "RUN", 100)
    passage = words(40, 1)
    rows = [(7, " ".join(words(50, 2)))] * 20000 + [(8, "")] * 20000 + [(None, None)] * 20000
    rows += [(9, " ".join(words(10, 3) + passage)), (9, " ".join(words(10, 4) + passage)), (10, " ".join(words(60, 5))), (11, "short")] + [(12, "too short to cut")] * 2
    docs = spark.createDataFrame([(i, t, None, None, 1, "c", None, "r", "k") for i, t in rows], DOC_SCHEMA).repartition(4)
    rest = substring.F.struct(*(c for c in docs.columns if c != "text")).alias("rest")
    assert substring._counted(docs.select(rest, "text").where("text != ''")).count() == 6
    found = Counter(map(tuple, cut_repeats(docs, 35).select("rest.doc_id", "n_words", "n_removed", "kept").collect()))
    assert found == Counter((i, *e) for (i, _), e in zip(rows, expected([t for _, t in rows], 35)))
