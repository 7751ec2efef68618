import pytest

from narrata.llm import queries
from tests.compare import connect, difference


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert difference(spark, connect(sf), queries.QUERIES[name], queries.ORACLE_SQL[name], sf) == ""
