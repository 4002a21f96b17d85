"""Every registered query against its SQL on the small tables; the others must return rows."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert {"doc_id", "overall_bias_score"} <= set(df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, key):
    assert compare(QUERIES[key](spark, SF), duck, ORACLES[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(spark, key):
    assert QUERIES[key](spark, SF).limit(1).count() == 1


def test_no_oracle_without_query():
    assert set(ORACLES) <= set(QUERIES)
