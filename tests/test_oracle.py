"""Every registered query against its independent SQL on the same tables."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry
from tendero.plans.oracle import ORACLE
from tendero.plans.registry import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = connect(sf_dir)
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) == []


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
