"""Every registered query with SQL gives the SQL's answer on the smallest tables."""
import pytest

import __spark_entry__ as E
from check_entries import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_flagship(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(E.CORE))
def test_query(spark, con, name):
    df = E.queries()[name](spark, SF)
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
        return
    status, note = compare(df, con, sql)
    assert status in ("exact", "CLOSE"), note
