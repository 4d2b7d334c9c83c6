"""Common lines against counting documents by line."""

import re
from collections import defaultdict

import pytest
from cases import DOC_SCHEMA

from tendero.llm.line_dedup import cut_lines, without_common_lines

LONG = "this line is long enough to be a key of at least forty characters"
ACCENT = "é" * 40
SHORT = "é" * 39


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$", "", line))


def expected(rows, least_docs, least_chars):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key_of(line)) >= least_chars:
                holders[key_of(line)].add(i)
    made = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(holders[key_of(x)]) < least_docs or i == max(holders[key_of(x)])]
        made.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(made, key=str)


def texts():
    rows = [(i, f"own line {i}\n  {LONG.upper()}\t\r\nend {i}\n") for i in range(7)]
    rows += [(i, f"{ACCENT}\n{SHORT}\n{ACCENT} ") for i in range(10, 15)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, LONG), (23, LONG + "\nanother"), (None, LONG + "\nno id"), (None, None)]
    rows += [(30, f"{LONG} twice\n{LONG} twice"), (30, f"{LONG} twice"), (31, f"{LONG} twice"), (32, f"{LONG} twice")]  # five rows of three ids
    rows += [(40, "\n".join(f"line {k} of a very long text, one of twenty thousand, all of them distinct" for k in range(20000)) + "\n" + LONG)]
    rows += [(50, "É" + LONG), (51, "é" + LONG)] * 3  # only A-Z are folded
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1, "c", None, "r", "k") for i, t in rows], DOC_SCHEMA).repartition(3)


@pytest.mark.parametrize(("least_docs", "least_chars"), [(5, 40), (2, 1), (1, 40)])
def test_lines_are_those_of_counting(spark, least_docs, least_chars):
    found = cut_lines(frame(spark, texts()), least_docs, least_chars).select("rest.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, found), key=str) == expected(texts(), least_docs, least_chars)


def test_many_equal_rows_and_a_line_in_all(spark):
    rows = [(7, LONG + "\nsame")] * 3000 + [(None, LONG)] * 1000 + [(i, LONG + f"\n{i}") for i in range(100, 110)]
    found = cut_lines(frame(spark, rows)).select("rest.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, found), key=str) == expected(rows, 5, 40)


def test_rows_keep_their_columns_and_empty_tables_work(spark, docs, no_docs):
    assert cut_lines(no_docs).collect() == []
    kept = without_common_lines(docs, 1, 10)
    assert kept.schema.names == docs.schema.names and kept.count() == docs.count()
    same = without_common_lines(docs, 10**6, 1)
    assert sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
