"""Every registered query against its SQL at the smallest scale."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

from pricelens.plans.oracle import ORACLE
from pricelens.plans.queries import QUERIES

from .oracle_check import compare, connect

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test data absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(con, spark, SF, QUERIES[name], ORACLE[name]) == ""


def test_entry(spark):
    report = entry.entry(spark)
    assert report.columns == ["n", "product_key", "alert_key", "message"]
    assert report.count() > 0
