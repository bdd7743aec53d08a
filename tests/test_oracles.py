import pytest
from oracle import SF, both, connect

from factloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        got, want = both(spark, con, QUERIES[name], ORACLES[name])
        assert got == want
    else:
        assert QUERIES[name](spark, SF).count() > 0
