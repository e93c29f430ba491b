"""Every core query against its oracle, and those without one for rows and a stable schema."""

import pytest
from conftest import SF, rows_of

from corpusmill import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0
    assert QUERIES[name](spark, SF).schema == df.schema
