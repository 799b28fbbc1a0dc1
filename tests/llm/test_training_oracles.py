import pytest
from oracle import HAVE, differs

from contigbin.llm import queries


@pytest.mark.skipif(not HAVE, reason="supplied tables are absent")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert differs(spark, queries.QUERIES[name], queries.ORACLES[name]) == ([], [], 0)
