import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import both, connect

from factloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    got, want = both(spark, connect(), queries.queries()[name], queries.oracle_sql()[name])
    assert got == want
