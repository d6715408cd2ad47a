import pytest

from rotaspark.llm import entry
from tests.oracle import connect, difference


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    assert difference(entry.queries()[name](spark, sf), entry.oracle_sql()[name], connect(sf)) is None
