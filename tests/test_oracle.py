"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry
from catalog import ORACLE as ORACLES
from catalog import QUERIES
from check import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry(spark)
    assert df.count() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    assert "l_returnflag_A" in df.columns
