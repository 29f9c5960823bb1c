"""Every catalogued query against its SQL, on the smallest tables."""

import pytest

from strataclaim.plans import catalog
from tests.oracle import connect, same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert df.count() > 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
