"""Every registered query against its SQL twin on the smallest data."""

import pytest

import __spark_entry__ as entry
from quire.plans import catalog
from tools.check import compare, connect

QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    got = QUERIES[name](spark, sf).toArrow()
    if name in SQL:
        assert compare(got, con.execute(SQL[name]).to_arrow_table()) is None
    else:
        assert got.num_rows > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
