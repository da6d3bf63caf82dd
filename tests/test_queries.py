"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["superProvider", "storeId", "itemCode"]
    assert df.limit(1).count() == 1
