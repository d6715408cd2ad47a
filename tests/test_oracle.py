import pytest

from rotaspark import queries as core
from tests.oracle import connect, difference


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert difference(core.QUERIES[name](spark, sf), core.SQL[name], connect(sf)) is None
