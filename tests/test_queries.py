"""Every query of the core against its SQL, on the smallest tables; the rest must run."""

import pytest

from tests.oracle import connect, same
from weftgraph import queries as core


@pytest.fixture(scope="module")
def connection(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, data, connection, name):
    df = core.queries()[name](spark, data)
    sql = core.oracle_sql().get(name)
    if sql:
        same(df, connection, sql)
    else:
        assert df.columns
        df.collect()


def test_all_sql_has_a_query():
    assert set(core.oracle_sql()) <= set(core.queries())
