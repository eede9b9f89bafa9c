"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert compare(spark, con, QUERIES[name], SQL[name], SF) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_every_sql_text_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert df.columns == entry_module.entry(spark).columns
