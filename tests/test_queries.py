"""Every query of the library's own operators against its SQL; those without SQL must run and are tested elsewhere."""

import pytest
from tests.compare import connect, difference

from narrata.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    if name in registry.ORACLE_SQL:
        assert difference(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], sf) == ""
    else:
        assert registry.QUERIES[name](spark, sf).count() > 0
