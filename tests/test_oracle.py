"""Every registered query against its SQL twin in DuckDB."""

import pytest
from compare import connect, difference

from glyphmill import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    mine = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        assert not difference(mine, duck.execute(SQL[name]).df())
    else:
        assert len(mine)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
