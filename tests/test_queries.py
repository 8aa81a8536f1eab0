"""Every query against its SQL on the small tables; each must have rows, so that nothing matches emptily."""

import pytest

from leafloom.plans import catalog_queries, oracles

QUERIES, SQL = catalog_queries(), oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, same_rows):
    df = QUERIES[name](spark, small)
    if name in SQL:
        assert same_rows(df, SQL[name]) > 0
    else:
        assert df.limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
