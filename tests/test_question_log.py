"""The columnar question log: folds, broken folds, days, tables made of arriving rows."""

import datetime as dt
import re

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tendero.sources import question_log as Q, sinks, snapshots
from tendero.streaming.questions import tag_arriving

DAYS = [dt.date(2026, 1, d) for d in (1, 2, 3)]
DICTIONARY = "position int, category string, family string, subfamily string, synonyms array<string>, brands array<string>"


def arrive(spark, log, numbers, text="pregunta"):
    """One question for each number, three days in turn; a negative number has no timestamp."""
    rows = spark.createDataFrame([(n, f"{text} {n}") for n in numbers], "n int, pregunta string")
    stamp = F.when(F.col("n") >= 0, F.timestamp_seconds(F.lit(1767225600) + (F.col("n") % 3) * 86400 + F.col("n")))
    sinks.append_query_log(rows.select(
        stamp.alias("timestamp"), "pregunta", F.lit("sí").alias("respuesta"), F.lit("").alias("modo"),
        F.col("n").cast("double").alias("tiempo_seg")), log)


def asked(rows):
    return sorted(r["pregunta"] for r in rows.collect())


@pytest.fixture
def paths(tmp_path):
    return str(tmp_path / "log"), str(tmp_path / "folded")


def test_every_row_is_folded_once(spark, paths):
    log, base = paths
    arrive(spark, log, range(-2, 30))
    assert Q.fold_log(spark, log, base).version == 1
    assert Q.fold_log(spark, log, base).version == 1  # nothing arrived
    arrive(spark, log, range(30, 40))
    Q.fold_log(spark, log, base)
    json_rows = sinks.read_query_log(spark, log)
    folded = Q.read_folded_log(spark, base)
    assert folded.count() == 42
    assert folded.select(*json_rows.columns).exceptAll(json_rows).isEmpty()
    assert Q.read_folded_log(spark, base, version=1).count() == 32


def test_many_files_fold_in_rounds(spark, paths):
    log, base = paths
    for n in range(0, 12, 3):
        arrive(spark, log, range(n, n + 3))
    Q.fold_log(spark, log, base, files_per_round=2)
    assert snapshots.snapshot(spark, base).version > 1
    assert asked(Q.read_folded_log(spark, base)) == sorted(f"pregunta {n}" for n in range(12))


@pytest.mark.parametrize("published", [False, True])
def test_a_fold_that_breaks_off_loses_and_doubles_nothing(spark, paths, monkeypatch, published):
    log, base = paths
    arrive(spark, log, range(5))
    Q.fold_log(spark, log, base)
    arrive(spark, log, range(5, 9))

    def broken(*args, **named):
        if published:
            snapshots.publish(*args, **named)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Q, "publish", broken)
        with pytest.raises(StreamingQueryException):
            Q.fold_log(spark, log, base)
    assert Q.read_folded_log(spark, base).count() == (9 if published else 5)
    assert Q.fold_log(spark, log, base).version == 2
    arrive(spark, log, [9])
    Q.fold_log(spark, log, base)
    assert asked(Q.read_folded_log(spark, base)) == sorted(f"pregunta {n}" for n in range(10))


def test_a_day_opens_its_own_files(spark, paths):
    log, base = paths
    arrive(spark, log, range(-1, 9))
    Q.fold_log(spark, log, base)
    arrive(spark, log, [1, 4])  # second day only
    Q.fold_log(spark, log, base)
    one = Q.read_folded_log(spark, base, DAYS[1], DAYS[1])
    assert one.count() == 5
    assert {r[0] for r in one.select("day").distinct().collect()} == {DAYS[1]}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan) and "DataFilters: []" in plan  # no other folder is opened
    first = Q.read_folded_log(spark, base, last=DAYS[0])
    batches = snapshots.snapshot(spark, base).of(Q.QUESTIONS)
    assert not any(batches[1].name in f for f in first.inputFiles())
    assert asked(first) == ["pregunta 0", "pregunta 3", "pregunta 6"]
    assert Q.read_folded_log(spark, base, dt.date(2030, 1, 1)).count() == 0
    assert Q.read_folded_log(spark, base).where("day IS NULL").count() == 1


def test_batches_are_put_together(spark, paths):
    log, base = paths
    for n in range(3):
        arrive(spark, log, range(n * 4, n * 4 + 4))
        Q.fold_log(spark, log, base)
    before = asked(Q.read_folded_log(spark, base))
    packed = Q.compact_log(spark, base)
    assert len(packed.of(Q.QUESTIONS)) == 1
    assert asked(Q.read_folded_log(spark, base)) == before
    old = packed.of(Q.QUESTIONS)[0]
    for n in (20, 21):
        arrive(spark, log, [n])
        Q.fold_log(spark, log, base)
    again = Q.compact_log(spark, base)
    assert len(again.of(Q.QUESTIONS)) == 2 and old in again.of(Q.QUESTIONS)
    assert asked(Q.read_folded_log(spark, base)) == sorted(before + ["pregunta 20", "pregunta 21"])


def test_nothing_folded(spark, paths):
    log, base = paths
    sinks.append_query_log(spark.createDataFrame([], sinks.QUERY_LOG_SCHEMA), log)
    with pytest.raises(ValueError):
        Q.read_folded_log(spark, base)
    with pytest.raises(ValueError):
        Q.compact_log(spark, base)


def test_a_brand_added_between_two_folds_tags_the_second(spark, paths, tmp_path):
    log, base = paths
    brands = str(tmp_path / "dictionary")

    def dictionary():
        return spark.read.schema(DICTIONARY).parquet(brands)

    def add(position, brand):
        spark.createDataFrame([(position, brand, "bebidas", None, [], [brand])], DICTIONARY).write.mode("append").parquet(brands)

    def tagged():
        rows = Q.read_folded_log(spark, base, table="tagged").collect()
        return sorted((r["pregunta"], tuple(r["brands"])) for r in rows)

    add(0, "norte")
    arrive(spark, log, [1, 2], "cerveza norte o quilmes")
    tag_arriving(spark, log, base, dictionary)
    add(1, "quilmes")
    arrive(spark, log, [3, 4], "cerveza norte o quilmes")
    tag_arriving(spark, log, base, dictionary)
    expected = [(f"cerveza norte o quilmes {n}", ("norte",) if n < 3 else ("norte", "quilmes")) for n in (1, 2, 3, 4)]
    assert tagged() == expected
    tag_arriving(spark, log, base, dictionary)  # nothing arrived
    assert len(Q.compact_log(spark, base).of("tagged")) == 1
    assert tagged() == expected


def test_tags_and_rows_appear_together(spark, paths):
    log, base = paths
    arrive(spark, log, range(3))
    calls = []

    def lost():
        calls.append(1)
        raise RuntimeError("no dictionary")

    with pytest.raises(StreamingQueryException):
        tag_arriving(spark, log, base, lost)
    assert calls and snapshots.snapshot(spark, base) is None
    tag_arriving(spark, log, base, lambda: spark.createDataFrame([(0, "x", None, None, ["pregunta"], [])], DICTIONARY))
    for table in (Q.QUESTIONS, "tagged"):
        assert asked(Q.read_folded_log(spark, base, table=table)) == [f"pregunta {n}" for n in range(3)]
    assert Q.read_folded_log(spark, base, table="tagged").where("category = 'x'").count() == 3
