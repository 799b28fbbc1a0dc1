import pytest
from oracle import DATA, HAVE, differs

from contigbin.plans import queries

pytestmark = pytest.mark.skipif(not HAVE, reason="supplied tables are absent")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert differs(spark, queries.QUERIES[name], queries.ORACLES[name]) == ([], [], 0)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
