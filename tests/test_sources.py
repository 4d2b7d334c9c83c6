import datetime as dt

import pytest
from pyspark.sql import functions as F

from tendero.functions import predicates as P
from tendero.plans.filters import SalesFilter, keep
from tendero.sources import shared, sinks
from tendero.sources.mart import (
    SOURCE_COLUMNS, SOURCE_TABLES, conform, load_mart, nulled_values, run_select, unparsed_dates,
    write_mart,
)
from tendero.streaming import questions


def test_mart_written_by_month_reads_back(spark, mart, tmp_path):
    write_mart(mart, str(tmp_path))
    back = load_mart(spark, str(tmp_path))
    assert "sale_month" in back.tickets.columns
    assert list((tmp_path / "tickets").glob("batch=*/sale_month=*"))
    for name, df in mart.tables().items():
        assert back.tables()[name].count() == df.count()


def test_warehouse_names_are_mapped(spark, mart, tmp_path):
    for name, df in mart.tables().items():
        ours_to_source = {v: k for k, v in SOURCE_COLUMNS[name].items()}
        columns = [F.col(c).cast("string" if c == "sale_date" else df.schema[c].dataType)
                   .alias(ours_to_source.get(c, c).upper()) for c in df.columns if c != "sale_month"]
        df.select(*columns).write.parquet(f"{tmp_path}/{SOURCE_TABLES[name]}")
    back = load_mart(spark, str(tmp_path), SOURCE_TABLES, SOURCE_COLUMNS)
    assert dict(back.tickets.dtypes)["sale_date"] == "date"
    assert back.tickets.agg(F.max("sale_date")).first() == mart.tickets.agg(F.max("sale_date")).first()


def test_bad_dates_become_null_and_are_counted(spark):
    df = spark.createDataFrame([("2026-01-02",), ("02/01/2026",), (None,)], "sale_date string")
    assert tuple(unparsed_dates(df).first()) == (3, 1, 1)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="po_supplier"):
        conform(spark.createDataFrame([(1, 2.0, dt.date(2026, 1, 1))],
                                      "item_key long, last_cost double, last_po_date date"), "last_prices")


@pytest.mark.parametrize("sql", [
    "", "  ", ";", None, "DROP TABLE tickets", "SELECT 1; DELETE FROM tickets", "with x as (select 1) insert into t select * from x",
    "selection", "EXPLAIN SELECT 1", "create table t as select 1", "/* select */ DROP TABLE tickets", "-- select\nDROP TABLE tickets",
    "FROM alerts SELECT 1", "TABLE alerts", "DESCRIBE alerts", "SET spark.x=1", "SELECT 1 /* open", "SELECT 1) UNION (DROP TABLE t",
    "SELECT 1; SELECT 2", "EXECUTE IMMEDIATE 'SELECT 1'", "SELECT 1) ; DROP TABLE alerts -- ",
])
def test_only_reading_is_allowed(sql, spark, mart):
    with pytest.raises(ValueError):
        run_select(spark, sql, mart)


@pytest.mark.parametrize("sql", [
    "SELECT updated_at, 'delete' AS word, \"drop\" AS other FROM (SELECT 1 AS updated_at);",
    "-- insert\nSELECT 1 /* update */ -- alter", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r",
    "SELECT * FROM VALUES (1), (2) v(x)", "WITH alerts AS (SELECT family FROM alerts) SELECT count(*) FROM alerts",
    "SELECT (SELECT max(days_cover) FROM alerts) AS m, EXISTS (SELECT 1 FROM catalog) AS e",
    "SELECT a.family FROM alerts a, LATERAL (SELECT max(stk_total) FROM catalog c WHERE c.item_key = a.item_key) t",
])
def test_words_are_no_commands(sql, spark, mart):
    assert run_select(spark, sql, mart).count() > 0


def test_select_is_cut_only_on_request(spark, mart):
    rows = mart.tickets.count()
    assert run_select(spark, "SELECT * FROM tickets", mart).count() == rows
    assert run_select(spark, "SELECT * FROM tickets", mart, max_rows=50).count() == 50


def test_select_takes_parameters(spark, mart):
    rows = run_select(spark, "WITH x AS (SELECT branch FROM tickets WHERE branch = :b) SELECT count(*) AS n FROM x",
                      mart, {"b": "asia"})
    assert rows.first()["n"] == mart.tickets.where("branch = 'asia'").count()


@pytest.mark.parametrize("sql", [
    "SELECT count(*) FROM parquet.`/root/testdata/sf0.001/customer.parquet`",
    "SELECT * FROM foreign_table",
    "SELECT a.n FROM (SELECT count(*) AS n FROM tickets) a JOIN other_table ON true",
    "SELECT java_method('java.util.UUID', 'randomUUID') FROM alerts",
    "SELECT reflect('java.util.UUID', 'randomUUID')",
    "SELECT * FROM range(10)",
    "SELECT '== Analyzed Logical Plan ==' AS a, count(*) FROM parquet.`/root/testdata/sf0.001/customer.parquet`",
    "WITH foreign_table AS (SELECT * FROM foreign_table) SELECT count(*) FROM foreign_table",
    "SELECT 'CTE [foreign_table]' AS a, count(*) FROM foreign_table",
    "SELECT count(*) FROM alerts WHERE item_key IN (SELECT id FROM foreign_table)",
    "SELECT (SELECT max(id) FROM foreign_table) AS m",
    "WITH a AS (WITH b AS (SELECT * FROM foreign_table) SELECT * FROM b) SELECT a.id FROM a JOIN alerts ON false",
    "SELECT 1) t, foreign_table WHERE (1 = 1",
    "SELECT r'\\' AS a, reflect('java.util.UUID', 'randomUUID') AS b, '' AS c",
    "SELECT `try_reflect`('java.util.UUID', 'randomUUID')",
    "SELECT count(*) FROM alerts WHERE java_method('java.util.UUID', 'randomUUID') > ''",
    "SELECT TRANSFORM(family) USING 'cat' AS (f) FROM alerts",
    "SELECT * FROM global_temp.foreign_table", "SELECT * FROM spark_catalog.default.foreign_table",
])
def test_select_sees_nothing_but_the_mart(spark, mart, sql):
    spark.range(1).createOrReplaceTempView("foreign_table")
    with pytest.raises(ValueError):
        run_select(spark, sql, mart)


def test_select_leaves_the_callers_views(spark, mart):
    spark.range(7).createOrReplaceTempView("alerts")
    try:
        rows = run_select(spark, "WITH t AS (SELECT family FROM alerts) SELECT count(family) AS n FROM t", mart)
        assert rows.first()["n"] == mart.alerts.count()
        assert spark.table("alerts").count() == 7
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("tendero_")]
    finally:
        spark.catalog.dropTempView("alerts")


def test_values_that_do_not_fit_are_counted(spark):
    df = spark.createDataFrame([("2026-01-01", "5"), ("01/02/26", "x"), (None, None)], "sale_date string, item_key string")
    found = {r["column_name"]: (r["filled"], r["nulled"]) for r in nulled_values(df, "tickets").collect()}
    assert found == {"sale_date": (2, 1), "item_key": (2, 1)}


def test_last_day_alone_restricts(mart):
    flt = SalesFilter(date_to="1999-01-01")
    assert keep(mart.tickets, flt.period(mart.tickets)).agg(F.max("sale_date")).first()[0] <= dt.date(1999, 1, 1)


def test_pack_sizes_are_read_as_numbers(spark):
    df = spark.createDataFrame([("vino 750cc",), ("gaseosa 1,5l",), ("agua 2.25 L",), ("yerba x500g",), ("pan",)], "description string")
    cc = [r[0] for r in df.select(P.pack_amount("description", P.VOLUME)).collect()]
    assert cc == [750.0, 1500.0, 2250.0, None, None]
    assert df.where(P.volume_at_least("description", 500)).count() == 3
    assert df.where(P.weight_at_least("description", 500)).count() == 1


def test_two_stream_runs_keep_all_questions(spark, tmp_path):
    def ask(text):
        rows = [(dt.datetime(2026, 1, 1), text, None, None, None)]
        sinks.append_query_log(spark.createDataFrame(rows, sinks.QUERY_LOG_SCHEMA), str(tmp_path / "log"))

    for text in ("uno", "dos"):
        ask(text)
        stream = questions.read_questions(spark, str(tmp_path / "log")).select("pregunta")
        questions.write_tagged(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r[0] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["dos", "uno"]


def test_detail_keeps_its_order(spark, tmp_path):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("n")).repartition(5)
    sinks.write_detail(df, str(tmp_path / "out"), "csv", [F.desc("n")])
    lines = []
    for part in sorted((tmp_path / "out").glob("part-*.csv")):
        lines += [int(x) for x in part.read_text().split()[1:]]
    assert lines == list(range(99, -1, -1))


def test_query_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    columns = "timestamp timestamp, pregunta string, respuesta string, modo string, tiempo_seg double"
    day = dt.datetime(2026, 6, 6, 12, 0)
    for modo, sec in ((None, 1.26), ("", 0.0), ("template", 2.25)):
        sinks.append_query_log(spark.createDataFrame([(day, "¿qué?", "así", modo, sec)], columns), path)
    rows = sorted((r["modo"], r["tiempo_seg"]) for r in sinks.read_query_log(spark, path)
                  .where("tiempo_seg is not null").collect())
    assert rows == [("ninguno", 1.3), ("template", 2.2)]
    assert sinks.read_query_log(spark, path).count() == 3


class FakeSession:
    """The parts of a session that name folders."""

    def __init__(self, **conf):
        values = {key.replace("_", "."): value for key, value in conf.items()}
        self.conf = type("Conf", (), {"get": lambda _, key, default=None: values.get(key, default)})()
        self.sparkContext = self
        self.folder = None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_is_the_one_named():
    session = FakeSession(spark_checkpoint_dir="hdfs://n/tmp/", spark_master="yarn")
    assert shared.shared_folder(session) == "hdfs://n/tmp"
    assert shared.new_path(session, "x") != shared.new_path(session, "x")


def test_cluster_must_name_a_folder():
    with pytest.raises(ValueError):
        shared.shared_folder(FakeSession(spark_master="yarn"))


def test_local_run_makes_one_folder():
    session = FakeSession(spark_master="local[2]")
    assert shared.shared_folder(session) == shared.shared_folder(session)
