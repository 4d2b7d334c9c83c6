"""A third of all lines on one order, one item and one customer."""

import re

import pytest
from compare import connect, differences

from tendero.plans.oracle import ORACLE
from tendero.plans.registry import QUERIES
from tendero.sources.star import star_tickets

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    # several map tasks, since a hot partition is split along their outputs
    "spark.sql.files.maxPartitionBytes": "16k",
    "spark.sql.files.openCostInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture(scope="module")
def skewed(sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = connect(sf_dir)
    changed = {
        "lineitem": """SELECT * REPLACE (
            CASE WHEN n % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey,
            CASE WHEN n % 3 = 0 THEN 11 ELSE l_partkey END AS l_partkey,
            CASE WHEN n % 3 = 0 THEN CAST(100 + n AS INT) ELSE l_linenumber END AS l_linenumber)
            FROM (SELECT *, row_number() OVER () AS n FROM lineitem)""",
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey) FROM orders",
    }
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"COPY ({changed.get(name, f'SELECT * FROM {name}')}) TO '{folder}/{name}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 512)")
    con.close()
    return folder


@pytest.fixture
def small_partitions(spark):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_keys_are_split_in_the_joins(spark, skewed, small_partitions):
    df = star_tickets(spark, skewed)
    rows = df.collect()
    con = connect(skewed)
    assert len(rows) == con.execute("SELECT count(*) FROM lineitem").fetchall()[0][0]
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"SortMergeJoin\(skew=true\)", final)) >= 2


@pytest.mark.parametrize("name", [
    "top_sellers", "sales_by_branch", "family_margin_leaders_period", "month_kpis", "items_ranked",
    "sale_vs_purchase_all", "high_sales_low_margin", "critical_with_sales", "how_much_to_order",
    "budget_by_supplier", "trend_summary", "trend_items", "urgency_index_flat", "tag_descriptions",
])
def test_results_hold_under_skew(name, spark, skewed, small_partitions):
    con = connect(skewed)
    assert differences(QUERIES[name](spark, skewed), con, ORACLE[name]) == []
