import pytest

from samewise.llm import registry
from tests.compare import compare


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_against_sql(spark, name):
    compare(spark, name, registry.queries()[name], registry.oracles()[name], "/root/testdata/sf0.001")
